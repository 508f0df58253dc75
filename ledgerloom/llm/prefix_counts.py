"""Token counts: prefix dynamic programming holds the exact token count at every prefix of a text.

A merge-based tokeniser encodes each word on its own, and an encoding is right exactly if each of its tokens is and
each two neighbours are: no merge across the seam between them would have come before the merges that made them. So
the encoding of a prefix of a word ends in the one token that is compatible with the encoding of what stands before
it, and count(prefix) = count(prefix without that token) + 1. Counts at the prefixes of short words are remembered
across words; long words are gone through by position. Counts at the ends of a text's stretches between white space are
their sums, which is all that a total or a cut at a stretch takes; a table adds the prefixes within each stretch.

A table answers how many tokens any prefix has and where to cut for a budget, without encoding again.

Defined results: a null text is empty and has no tokens; special strings inside texts count as the library's default
has it, one token each; very long texts and words are counted whole, in memory that grows with the longest text;
repeated rows and null ids pass through; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import json
import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import slices, small_batches, text_or_empty, tidied, tokenizer_path

#: The pattern by which this vocabulary's words are cut.
WORDS = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
_SPACES = regex.compile(r"\s+")
_ODD_SPACES = regex.compile("[\x1c-\x1f]")
_STRETCHES = regex.compile(r"(\s+)|[^\s]+")
_WORDS = regex.compile(r"[^\s]+")
_FAR = 1 << 60
_ONE = (1,)
#: Words of up to so many bytes and stretches of up to so many characters are remembered.
SHORT, MEDIUM = 24, 48


class PrefixCounter:
    """Counts by prefix for a tokenizers file of the kind "BPE with word ends" whose words are cut by WORDS."""

    def __init__(self, tokenizer: str, most: int = 400_000):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        path = tokenizer_path(tokenizer)
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.normalizer = Tokenizer.from_file(path).normalizer
        self.words = regex.compile(WORDS)
        self.special = regex.compile("|".join(regex.escape(t["content"]) for t in spec["added_tokens"]) or r"(?!)")
        self.special_marks = {t["content"][:1] for t in spec["added_tokens"]}
        self.end = spec["model"]["end_of_word_suffix"] or ""
        merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in spec["model"]["merges"]]
        self.rank = {m: i for i, m in enumerate(merges)}
        self.tokens = set(spec["model"]["vocab"])
        # Lengths of the tokens that end in two given signs, longest first and at last 1: inside a word, and at its end.
        self.inside, self.at_end = self._lengths(False), self._lengths(True)
        self.made: dict[str, tuple[int, str, str]] = {}
        for i, (a, b) in enumerate(merges):
            self.made.setdefault(a + b, (i, a, b))
        prints = [*range(33, 127), *range(161, 173), *range(174, 256)]
        self.signs = dict(zip([b for b in range(256) if b not in prints], range(256, 512), strict=False))
        self.most = most
        self.left: dict[str, list] = {}
        self.right: dict[str, list] = {}
        self._forget()

    def _lengths(self, at_end: bool) -> dict[str, tuple[int, ...]]:
        out: dict[str, set[int]] = {}
        for token in self.tokens:
            if at_end and not (token.endswith(self.end) and len(token) > len(self.end)):
                continue
            body = token.removesuffix(self.end) if at_end else token
            if len(body) > 1:
                out.setdefault(body[-2:], {1}).add(len(body))
        return {k: tuple(sorted(v, reverse=True)) for k, v in out.items()}

    def _forget(self) -> None:
        self.inner: dict[str, tuple[int, str]] = {"": (0, "")}
        self.final: dict[str, int] = {}
        self.chunks: dict[str, int] = {}
        self.stored: dict[str, bytes] = {}
        self.seams: dict[tuple[str, str], bool] = {}

    def _spine(self, token: str, side: int) -> list[tuple[str, int, int]]:
        """What stands at one edge of a token while it is made: (symbol, from this merge on, until this merge)."""
        kept = (self.left, self.right)[side]
        if token not in kept:
            out, until, x = [], _FAR, token
            while x in self.made:
                i, a, b = self.made[x]
                out.append((x, i, until))
                x, until = (a, b)[side], i
            kept[token] = [*out, (x, -1, until)]
        return kept[token]

    def _fits(self, a: str, b: str) -> bool:
        """Whether a and b stay apart: no merge across their seam comes while both its symbols stand there. Of equal merges the left one comes first."""
        if (known := self.seams.get((a, b))) is None:
            known = True
            for x, x_from, x_until in self._spine(a, 1):
                for y, y_from, y_until in self._spine(b, 0):
                    at = self.rank.get((x, y))
                    if at is not None and x_from < at < x_until and y_from < at <= y_until:
                        known = False
            self.seams[(a, b)] = known
        return known

    def _step(self, word: str, n: int, at_end: bool, inner: list[tuple[int, str]]) -> tuple[int, str]:
        """Token count and last token of word[:n] as a whole word (at_end) or as one that goes on; inner: of shorter ones that go on."""
        end = self.end if at_end else ""
        for size in (self.at_end if at_end else self.inside).get(word[max(0, n - 2) : n], _ONE):
            if size <= n and (token := word[n - size : n] + end) in self.tokens:
                count, last = inner[n - size]
                if not last or self._fits(last, token):
                    return count + 1, token
        raise ValueError(f"no token ends {word[:n]!r}")

    def _inner(self, prefix: str) -> tuple[int, str]:
        """Token count and last token of a short word's beginning, as one that goes on."""
        inner, inside, tokens, seams = self.inner, self.inside, self.tokens, self.seams
        for known in range(len(prefix) - 1, -1, -1):  # from the longest known one on
            if prefix[:known] in inner:
                break
        for n in range(known + 1, len(prefix) + 1):
            some = prefix[:n]
            for size in inside.get(some[-2:], _ONE):
                if size <= n and (token := some[n - size :]) in tokens:
                    count, last = inner[some[: n - size]]
                    if not last or (seams[last, token] if (last, token) in seams else self._fits(last, token)):
                        inner[some] = count + 1, token
                        break
            else:
                raise ValueError(f"no token ends {some!r}")
        return inner[prefix]

    def _final(self, word: str) -> int:
        """Tokens of a short word."""
        if (known := self.final.get(word)) is not None:
            return known
        n, inner = len(word), self.inner
        for size in self.at_end.get(word[-2:], _ONE):
            if size <= n and (token := word[n - size :] + self.end) in self.tokens:
                before = word[: n - size]
                count, last = inner.get(before) or self._inner(before)
                if not last or self._fits(last, token):
                    self.final[word] = count + 1
                    return count + 1
        raise ValueError(f"no token ends {word!r}")

    def _finals(self, word: str, every: bool = True) -> list[int]:
        """Tokens of each prefix of a word, or of the word alone. Long words are gone through by position and not remembered."""
        if len(word) <= SHORT:
            return [self._final(word[:n]) for n in range(1, len(word) + 1)] if every else [self._final(word)]
        inner: list[tuple[int, str]] = [(0, "")]
        out = []
        for n in range(1, len(word) + 1):
            if every or n == len(word):
                out.append(self._step(word, n, True, inner)[0])
            if n < len(word):
                inner.append(self._step(word, n, False, inner))
        return out

    def _signed(self, word: str) -> str:
        return word.encode("utf-8", "surrogatepass").decode("latin-1").translate(self.signs)

    def _plain(self, text: str) -> str:
        return text.lower() if text.isascii() else self.normalizer.normalize_str(text)

    def _chunk(self, chunk: str) -> int:
        """Tokens of a text without white space."""
        if self.special_marks & set(chunk) and self.special.search(chunk):
            parts = self.special.split(chunk)
            return len(parts) - 1 + sum(self._chunk(p) for p in parts if p)
        total = 0
        for w in self.words.findall(self._plain(chunk)):
            signed = w if w.isascii() and w.isalnum() else self._signed(w)
            total += self._final(signed) if len(signed) <= SHORT else self._finals(signed, False)[0]
        return total

    def _ordinary(self, chunk: str) -> list[int]:
        """Tokens of each prefix of a text without white space and special strings."""
        plain = self._plain(chunk)
        each = list(plain) if chunk.isascii() else list(map(self._plain, chunk))
        if "".join(each) != plain:  # characters that join with their neighbours: prefixes may be spelt otherwise
            return [sum(self._finals(self._signed(w), False)[0] for w in self.words.findall(self._plain(chunk[:k]))) for k in range(1, len(chunk) + 1)]
        out, done = [0], 0
        for m in self.words.finditer(plain):
            word = m[0]
            if word[0] == "'" and len(word) > 1 and word[1].isalpha():  # cut short, it is a sign and letters
                counts = [self._final(self._signed("'")), *(self._final(self._signed("'")) + self._final(self._signed(word[1:k])) for k in range(2, len(word))), self._final(self._signed(word))]
            else:
                every = self._finals(self._signed(word))
                counts = every if word.isascii() else [every[k - 1] for k in np.cumsum([len(c.encode("utf-8", "surrogatepass")) for c in word]).tolist()]
            out += [done + c for c in counts]
            done = out[-1]
        return [out[k] for k in np.cumsum(list(map(len, each))).tolist()]

    def prefixes(self, chunk: str) -> list[int]:
        """Tokens of each prefix of a text without white space. Inside a special string its characters are ordinary."""
        if not (self.special_marks & set(chunk) and self.special.search(chunk)):
            return self._ordinary(chunk)
        out, base, at = [], 0, 0
        for m in self.special.finditer(chunk):
            run = self._ordinary(chunk[at : m.end() - 1])
            out += [base + x for x in run]
            base += (run[m.start() - at - 1] if m.start() > at else 0) + 1
            out.append(base)
            at = m.end()
        return [*out, *(base + x for x in self._ordinary(chunk[at:]))] if at < len(chunk) else out

    def _store(self, chunk: str) -> int:
        """Tokens of a stretch, remembered if it is not long."""
        n = self._chunk(chunk)
        if len(chunk) <= MEDIUM:
            self.chunks[chunk] = n
        return n

    def _inside(self, chunk: str) -> bytes | list[int]:
        """prefixes(chunk), remembered if it is not long."""
        if (known := self.stored.get(chunk)) is None:
            known = self.prefixes(chunk)
            if len(chunk) <= MEDIUM and max(known) < 256 and len(self.stored) < self.most:
                known = self.stored[chunk] = bytes(known)
        return known

    def _cut(self, text: str) -> list[str]:
        return text.split() if not _ODD_SPACES.search(text) else [c for c in _SPACES.split(text) if c]

    def ends(self, text: str) -> list[int]:
        """Token counts of the stretches of a text between white space."""
        known = self.chunks
        if len(known) > self.most or len(self.inner) > 2 * self.most or len(self.seams) > 4 * self.most:
            self._forget()
            known = self.chunks
        cut = self._cut(text)
        got = list(map(known.get, cut))
        if None in got:
            for i, x in enumerate(got):
                if x is None:
                    got[i] = known[cut[i]] if cut[i] in known else self._store(cut[i])
        return got

    def count(self, text: str) -> int:
        return sum(self.ends(text))

    def table(self, text: str) -> np.ndarray:
        """Token counts of text[:p] for p from 0 to its length, each as if that prefix were encoded alone."""
        out, done = np.zeros(len(text) + 1, np.int64), 0
        counts = iter(self.ends(text))
        for m in _STRETCHES.finditer(text):
            if m[1] is not None:
                out[m.start() + 1 : m.end() + 1] = done
                continue
            inside = self._inside(m[0])
            out[m.start() + 1 : m.end() + 1] = np.frombuffer(inside, np.uint8) if isinstance(inside, bytes) else inside
            out[m.start() + 1 : m.end() + 1] += done
            done += next(counts)
        return out

    def cut(self, text: str, budget: int) -> int:
        """The longest prefix length up to which no prefix is over a budget of tokens."""
        over = np.flatnonzero(self.table(text) > budget)
        return int(over[0]) - 1 if len(over) else len(text)

    def whole(self, text: str, budget: int) -> tuple[int, int]:
        """Tokens of a text, and the length of its longest prefix of whole stretches that fits a budget."""
        counts = self.ends(text)
        total = sum(counts)
        if total <= budget:
            return total, len(text)
        end, done = 0, 0
        for m, n in zip(_WORDS.finditer(text), counts, strict=False):
            done += n
            if done > budget:
                break
            end = m.end()
        return total, end


_COUNTERS: dict[str, PrefixCounter] = {}


def counter(tokenizer: str) -> PrefixCounter:
    """One counter per worker process."""
    if tokenizer not in _COUNTERS:
        _COUNTERS[tokenizer] = PrefixCounter(tokenizer)
    return _COUNTERS[tokenizer]


def token_counts(docs: DataFrame, tokenizer: str = "word_bpe_49k.json", with_table: bool = False, id_col: str = "doc_id", text_col: str = "text", budget: int = 2048) -> DataFrame:
    """doc_id, n_bytes, n_tokens, cut_chars and, if asked for, table: the counts at every prefix (little-endian 32-bit, by characters).

    cut_chars: the length of the longest prefix of whole stretches between white space that has at most `budget` tokens.
    """
    small_batches(docs.sparkSession)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_or_empty(text_col).alias("text")).withColumn("n_bytes", F.octet_length("text").cast("long"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = counter(tokenizer)
        for batch in batches:
            for _, part in slices(batch):
                texts = part.column("text").to_pylist()
                found = [count.whole(t, budget) for t in texts]
                columns = [part.column("doc_id"), part.column("n_bytes"), *(pa.array([x[k] for x in found], pa.int64()) for k in range(2))]
                names = ["doc_id", "n_bytes", "n_tokens", "cut_chars"]
                if with_table:
                    columns, names = [*columns, pa.array([count.table(t).astype("<u4").tobytes() for t in texts], pa.binary())], [*names, "table"]
                yield pa.RecordBatch.from_arrays(columns, names)

    return rows.mapInArrow(lambda b: tidied(run(b)), "doc_id long, n_bytes long, n_tokens long, cut_chars long" + ", table binary" * with_table)


def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return token_counts(docs, "word_bpe_49k.json", budget=2048).withColumn("over_limit", F.col("n_tokens") > 2048)
