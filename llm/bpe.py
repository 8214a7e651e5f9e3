"""BPE encoding of whole texts by depth-first last-token states over a trie of distinct words.

In a byte-pair encoding every prefix of a word has one last token, and it
follows from the prefix before that token: t is the last token of a prefix
if it ends the prefix and (last token of the rest, t) stay apart when
merged. So the distinct words of a batch form a trie, states pass down it
once per node, and a word's encoding is read by walking its last tokens
backwards: words that share a prefix share its states. A word's final
symbol carries the end mark, so it is a leaf of its own below the shared
prefix.

The tokenizer file (public ``tokenizers`` JSON with a word-end BPE) is read
on the driver and sent to the tasks; nothing is trained. Text is handled as
that library does: special tokens are cut out of the raw text, then NFC,
lower-casing and the file's split pattern. Null text is empty: no tokens.
Decoding joins the token strings with spaces, as the library does for a
file without decoder.
"""

from __future__ import annotations

import functools
import gc
import json
import struct
import unicodedata
from collections.abc import Callable, Iterable, Iterator
from itertools import chain, filterfalse, islice, pairwise

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from llm.common import hold, release

#: Units (words with their punctuation) whose encoding a task keeps from one batch to the next; others are encoded again.
KEPT_WORDS = 400_000
#: Characters of text that are split and encoded together.
BATCH_CHARS = 2 << 20
_NEVER = 1 << 30
_ODD = ("\x1c", "\x1d", "\x1e", "\x1f")
_FAR = regex.compile("[^\x00-\u024f]")
#: A mark that the split pattern takes off a run of letters as a word of its own.
_MARKS = frozenset(".,;:!?")
#: Where a word ends without white space, whatever follows: no alternative of the split pattern goes on after a letter or digit with another sign.
_WORD_END = r"([\pL\pN])([^\s\pL\pN])"


def _byte_of_symbol() -> dict[str, int]:
    """Printable character -> byte, the byte-level convention: printable Latin-1 stands for itself."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class WordBpe:
    """Encoder and decoder of one tokenizer file.

    A symbol is one byte, as chr(byte), or as chr(256 + byte) if it ends its word.
    ``make`` turns a word's ids into what ``encode_batch`` returns for it, ``join`` those of a unit's words into one.
    """

    def __init__(self, source: str, make: Callable[[tuple[int, ...]], object] = tuple, join: Callable[[list], object] = lambda parts: sum(parts, ())):
        spec = json.loads(source)
        model = spec["model"]
        if spec["decoder"] is not None or not model["end_of_word_suffix"] or any(
                model[k] for k in ("unk_token", "dropout", "continuing_subword_prefix", "byte_fallback", "fuse_unk", "ignore_merges")):
            raise ValueError("only a word-end BPE file without decoder is supported")
        parts = spec["pre_tokenizer"]["pretokenizers"]
        names = [n["type"] for n in spec["normalizer"]["normalizers"]]
        if [p["type"] for p in parts] != ["Split", "ByteLevel"] or names != ["NFC", "Replace", "Lowercase"]:
            raise ValueError("unknown text handling in the tokenizer file")
        self.source, self.make, self.join = source, make, join
        self.words = regex.compile(parts[0]["pattern"]["Regex"])
        self.specials: dict[str, int] = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.cut = regex.compile("(" + "|".join(map(regex.escape, self.specials)) + ")") if self.specials else None
        #: what a text holds if Arrow cannot split it: far characters, a letter whose lower case has a mark, special tokens
        self.uneven = "|".join(["[^\\x00-\\x{24F}]|\\x{130}", *map(regex.escape, self.specials)])
        self.strings: dict[int, str] = {i: t for t, i in model["vocab"].items()} | {i: t for t, i in self.specials.items()}
        self.byte, end = _byte_of_symbol(), model["end_of_word_suffix"]
        own = {t: self._symbols(t, end) for t in model["vocab"]}
        self.id_of = {s: model["vocab"][t] for t, s in own.items()}
        self.own = {i: s for s, i in self.id_of.items()}
        self.size = {i: len(s) for s, i in self.id_of.items()}
        #: pair of ids -> rank and id of what they merge into
        self.merges = {(model["vocab"][a], model["vocab"][b]): (rank, model["vocab"][a + b]) for rank, (a, b) in enumerate(model["merges"])}
        made = {c: (rank, a, b) for (a, b), (rank, c) in self.merges.items()}
        self.left = {t: self._spine(t, made, 1) for t in self.size}
        self.right = {t: self._spine(t, made, 2) for t in self.size}
        self._suffixes()
        self.apart: dict[int, dict[int, bool]] = {t: {} for t in self.size}
        self.alone: dict[int, bool] = {}
        self.kept: dict[str, object] = {}
        self.passing: list[str] = []
        self.library = None

    def _suffixes(self) -> None:
        """An automaton over the tokens: what it reads last decides which tokens end here, longest first (``self.ends``)."""
        self.moves: list[dict[str, int]] = [{}]
        self.ends: list[tuple[int, ...]] = [()]
        for text, token in self.id_of.items():
            node = 0
            for c in text:
                if c not in self.moves[node]:
                    self.moves[node][c] = len(self.moves)
                    self.moves.append({})
                    self.ends.append(())
                node = self.moves[node][c]
            self.ends[node] = (token,)
        self.shorter = [0] * len(self.moves)
        queue = list(self.moves[0].values())
        for node in queue:
            for c, child in self.moves[node].items():
                queue.append(child)
                self.shorter[child] = self._move(self.shorter[node], c)
                self.ends[child] += self.ends[self.shorter[child]]
        #: the same with each token's size
        self.sized = [tuple([(t, self.size[t]) for t in ends]) for ends in self.ends]

    def _move(self, node: int, c: str) -> int:
        """The node after reading ``c``; ``encode_words`` enters those by way of shorter suffixes into ``moves`` as they come up."""
        while node and c not in self.moves[node]:
            node = self.shorter[node]
        return self.moves[node][c]

    def _symbols(self, token: str, end: str) -> str:
        if token.endswith(end) and len(token) > len(end):
            body = "".join(chr(self.byte[c]) for c in token[:-len(end)])
            return body[:-1] + chr(256 + ord(body[-1]))
        return "".join(chr(self.byte[c]) for c in token)

    @staticmethod
    def _spine(token: int, made: dict, side: int) -> list[tuple[int, int]]:
        """The tokens that stood at the token's left (1) or right (2) edge while it was built, each with the rank that took it."""
        out, taken = [(token, _NEVER)], _NEVER
        while token in made:
            taken, token = made[token][0], made[token][side]
            out.append((token, taken))
        return out

    # -- words of a text

    def split(self, text: str | None) -> list[str]:
        """The text's units: runs without white space, lower-cased. The split pattern never crosses white space,
        so it is applied to each distinct unit once (``_words_of``). A unit after "\\n" is a special token, one
        after " " is a word already."""
        if not text:
            return []
        pieces = self.cut.split(text) if self.cut and "<" in text else [text]
        out: list[str] = []
        for i, piece in enumerate(pieces):
            if i % 2:
                out.append("\n" + piece)
            elif not piece.isascii() and _FAR.search(piece):
                out += [" " + w for w in self._library_words(piece)]
            elif any(c in piece for c in _ODD):  # white space to Python, not to the pattern
                out += [" " + w for w in self.words.findall(unicodedata.normalize("NFC", piece).lower())]
            else:
                out += piece.lower().split()  # letters up to U+024F are in normal form
        return out

    def _words_of(self, unit: str) -> list[str]:
        if unit[0] == "\n" or unit.isalpha():
            return [unit]
        if unit[0] == " ":
            return [unit[1:]]
        if unit[-1] in _MARKS and unit[:-1].isalpha():
            return [unit[:-1], unit[-1]]
        return self.words.findall(unit)

    def _library_words(self, piece: str) -> list[str]:
        """Beyond Latin letters the library's own tables decide on letters and cases."""
        if self.library is None:
            from tokenizers import Tokenizer

            self.library = Tokenizer.from_str(self.source)
        found = self.library.pre_tokenizer.pre_tokenize_str(self.library.normalizer.normalize_str(piece))
        return [bytes(self.byte[c] for c in w).decode("utf-8") for w, _ in found]

    # -- which tokens stay apart

    def _merge(self, ids: list[int]) -> list[int]:
        """Plain merging, for the rare cases that the spines leave open."""
        while len(ids) > 1:
            rank, pair = min((self.merges.get(p, (_NEVER,))[0], p) for p in zip(ids, ids[1:]))
            if rank == _NEVER:
                break
            out, i = [], 0
            while i < len(ids):
                if tuple(ids[i:i + 2]) == pair:
                    out.append(self.merges[pair][1])
                    i += 2
                else:
                    out.append(ids[i])
                    i += 1
            ids = out
        return ids

    def _parts(self, token: int) -> list[int]:
        return [self.id_of[c] for c in self.own[token]]

    def _whole(self, token: int) -> bool:
        if token not in self.alone:
            self.alone[token] = self._merge(self._parts(token)) == [token]
        return self.alone[token]

    def _stays(self, left: int, right: int) -> bool:
        """Whether no merge crosses the border between the two while they are built."""
        merges = self.merges
        for x, x_taken in self.right[left]:
            for y, y_taken in self.left[right]:
                found = merges.get((x, y))
                if found:
                    rank = found[0]
                    if rank < x_taken and rank < y_taken:
                        return False
                    if rank == x_taken or rank == y_taken:
                        return self._merge(self._parts(left) + self._parts(right)) == [left, right]
        return True

    # -- the trie of words

    def encode_words(self, words: Iterable[str]) -> dict[str, tuple[int, ...]]:
        """The ids of each distinct word.

        Sorted words with their common prefixes are the trie in depth-first order: from one word to the next
        the states of the shared prefix stay, and only the new nodes below it get theirs.
        """
        out: dict[str, tuple[int, ...]] = {}
        words_of: dict[str, str] = {}
        for word in words:
            if word[0] == "\n":
                out[word] = (self.specials[word[1:]],)
                continue
            text = word if word.isascii() else word.encode("utf-8", "surrogatepass").decode("latin-1")
            words_of[text[:-1] + chr(256 + ord(text[-1]))] = word
        moves, sized, size, apart, alone = self.moves, self.sized, self.size, self.apart, self.alone
        last: list[int] = []  # the last token of each prefix on the way down
        nodes: list[int] = [0]  # and the automaton's node
        before = ""
        for text in sorted(words_of):
            depth = 0
            for x, y in zip(before, text):
                if x != y:
                    break
                depth += 1
            del last[depth:], nodes[depth + 1:]
            before, node = text, nodes[depth]
            for depth, c in enumerate(text[depth:], depth):
                here = moves[node]
                to = here.get(c)
                if to is None:
                    to = here[c] = self._move(node, c)
                node = to
                nodes.append(node)
                for token, n in sized[node]:  # the longest one that stays apart from what comes before it
                    if n == 1:
                        break
                    if n > depth:
                        stays = alone.get(token)
                        if stays is None:
                            stays = self._whole(token)
                    else:
                        left = last[depth - n]
                        stays = apart[left].get(token)
                        if stays is None:
                            stays = apart[left][token] = self._stays(left, token)
                    if stays:
                        break
                last.append(token)
            ids, at = [], len(text) - 1
            while at >= 0:
                token = last[at]
                ids.append(token)
                at -= size[token]
            ids.reverse()
            out[words_of[text]] = tuple(ids)
        return out

    # -- batches

    def encode_batch(self, texts: list[str | None]) -> tuple[list[list[str]], Callable[[str], object]]:
        """The units of each text, and a function from each of them to ``make`` of its ids."""
        split = [self.split(t) for t in texts]
        return split, self._learn(chain.from_iterable(split))

    def encode_texts(self, texts: list[str | None]) -> list[bytes]:
        """The ids of each text, by an encoder whose ``make`` gives bytes.

        Arrow cuts the texts at white space, tells equal units and lays out their ids, so that Python handles each
        distinct unit of the batch once. Texts with special tokens or beyond Latin letters are cut by ``split``.
        """
        column = pc.fill_null(pa.array(texts, pa.large_string()), "")
        uneven = pc.match_substring_regex(column, self.uneven)
        apart = pc.replace_substring_regex(pc.if_else(uneven, "", column), _WORD_END, r"\1 \2")
        lists = pc.ascii_split_whitespace(pc.ascii_lower(apart))
        units, of_text = lists.flatten(), np.repeat(np.arange(len(texts)), lists.value_lengths())
        others = np.flatnonzero(uneven.to_numpy(zero_copy_only=False))
        if len(others):
            split = [self.split(texts[i]) for i in others]
            of_text = np.concatenate([of_text, np.repeat(others, [len(s) for s in split])])
            order = np.argsort(of_text, kind="stable")
            units, of_text = pa.concat_arrays([units, pa.array(chain.from_iterable(split), units.type)]).take(pa.array(order)), of_text[order]
        coded = units.dictionary_encode()
        distinct = [u if u.isascii() or u[0] in "\n " else u.lower() for u in coded.dictionary.to_numpy(zero_copy_only=False).tolist()]
        of = self._learn(filter(None, distinct))  # an empty unit comes before leading white space, say
        laid = pa.array([of(u) if u else b"" for u in distinct], pa.large_binary()).take(coded.indices)
        ends = np.concatenate([[0], np.cumsum(pc.binary_length(laid).to_numpy())])
        firsts = np.searchsorted(of_text, np.arange(len(texts) + 1))
        data = (laid.buffers()[2] or b"") if len(laid) else b""
        return [bytes(data[a:b]) for a, b in pairwise(ends[firsts].tolist())]

    def _learn(self, units: Iterable[str]) -> Callable[[str], object]:
        """A function from each of the units to ``make`` of its ids."""
        known, make = self.kept, self.make
        for unit in self.passing:
            del known[unit]
        unknown = set(filterfalse(known.__contains__, units))
        collecting = gc.isenabled()
        gc.disable()  # no cycles are made here, and the collector would walk all that is kept again and again
        try:
            plain = {u for u in unknown if u.isalpha()}
            rest = {u: self._words_of(u) for u in unknown.difference(plain)}
            words = plain.union(*rest.values()).difference(known)
            made = {w: make(x) for w, x in self.encode_words(words).items()}
            room, join = max(0, KEPT_WORDS - len(known)), self.join
            new = {u: made[u] for u in plain}
            new.update((u, join([made.get(w) or known[w] for w in parts])) for u, parts in rest.items())
            known.update(new)
        finally:
            if collecting:
                gc.enable()
        self.passing = list(islice(new, room, None))
        if sum(map(len, self.apart.values())) > 1_000_000:
            self.apart = {t: {} for t in self.size}
        return known.__getitem__

    def settle(self) -> None:
        """At a task's end: keep no more than KEPT_WORDS units."""
        for unit in self.passing:
            del self.kept[unit]
        self.passing = []
        release()

    def decode(self, ids: Iterable[int]) -> str:
        return " ".join(self.strings[i] for i in ids)


def char_runs(texts: list[str | None], most: int = BATCH_CHARS) -> Iterator[slice]:
    """Runs of texts of about ``most`` characters; a longer text is a run of its own."""
    start, size = 0, 0
    for i, text in enumerate(texts):
        n = len(text or "")
        if size and size + n > most:
            yield slice(start, i)
            start, size = i, 0
        size += n
    if start < len(texts):
        yield slice(start, len(texts))


@functools.lru_cache(maxsize=2)
def _as_ids(source: str) -> WordBpe:
    return WordBpe(source)


@functools.lru_cache(maxsize=2)
def _as_strings(source: str) -> WordBpe:
    bpe = WordBpe(source)
    bpe.make = lambda ids: (len(ids), " ".join(map(str, ids)), bpe.decode(ids))
    bpe.join = lambda parts: (sum(p[0] for p in parts), " ".join([p[1] for p in parts]), " ".join([p[2] for p in parts]))
    return bpe


@functools.lru_cache(maxsize=2)
def as_bytes(source: str) -> WordBpe:
    """A worker process's encoder whose words come as little-endian unsigned 32-bit ids; later tasks use it again."""
    return WordBpe(source, lambda ids: struct.pack(f"<{len(ids)}I", *ids), b"".join)


for _encoder in (_as_ids, _as_strings, as_bytes):
    hold(_encoder.cache_clear)


def read_tokenizer(path: str) -> str:
    """The tokenizer file's text, read once on the driver."""
    with open(path, encoding="utf-8") as f:
        return f.read()


def encode(df: DataFrame, source: str, text_col: str = "text", tokens_col: str = "token_ids", decoded_col: str = "decoded") -> DataFrame:
    """``df`` with two more columns: the ids of each text, and their decoded text."""
    sent = df.sparkSession.sparkContext.broadcast(source)

    @F.pandas_udf("ids array<int>, text string")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        bpe = _as_ids(sent.value)
        for series in batches:
            texts, ids = series.tolist(), []
            for part in char_runs(texts):
                split, of = bpe.encode_batch(texts[part])
                ids += [[i for w in words for i in of(w)] for words in split]
            yield pd.DataFrame({"ids": ids, "text": [bpe.decode(x) for x in ids]})
        bpe.settle()

    names = [F.col(f"`{c}`") for c in df.columns]
    both = F.col("_bpe")
    return df.select(*names, run(F.col(text_col)).alias("_bpe")).select(*names, both.ids.alias(tokens_col), both.text.alias(decoded_col))


def digest(df: DataFrame, source: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id, n_tokens, ids_sha256, decoded_sha256)``: what ``encode`` gives, as digests made in the same pass."""
    sent = df.sparkSession.sparkContext.broadcast(source)
    id_type = df.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from hashlib import sha256

        bpe = _as_strings(sent.value)
        for pdf in batches:
            texts, rows = pdf["text"].tolist(), []
            for part in char_runs(texts):
                split, of = bpe.encode_batch(texts[part])
                for words in split:
                    n, ids, strings = zip(*map(of, words)) if words else ((), (), ())
                    rows.append((sum(n), sha256(" ".join(ids).encode()).hexdigest(), sha256(" ".join(strings).encode()).hexdigest()))
            out = pd.DataFrame(rows, columns=["n_tokens", "ids_sha256", "decoded_sha256"])
            out.insert(0, "id", pdf["id"].to_numpy())
            yield out
        bpe.settle()

    picked = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return picked.mapInPandas(run, f"id {id_type}, n_tokens long, ids_sha256 string, decoded_sha256 string").withColumnRenamed("id", id_col)
