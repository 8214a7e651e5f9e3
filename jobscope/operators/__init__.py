"""DataFrame -> DataFrame operators: normalisation, shares, latency, occupancy,
utilisation and duration models."""
