"""Token counts of byte-level BPE for every prefix of a text.

A text is cut into pieces by the vocabulary's pattern; merges never cross a piece.
Within a piece, a dynamic program over its prefixes keeps the last token and the
number of tokens of each prefix: prefix i ends with the one token t for which the
encoding of the prefix before it stays valid next to t, so count[i] = count[i - |t|] + 1.
Sums over pieces then give the count of any prefix of the text without encoding it again.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from functools import cached_property, lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from choicemeter.llm.common import per_process, slices, texts

# Fixed value: the pattern of the vocabulary.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
# Characters whose classes are the same in every Unicode version the two pattern engines know.
SETTLED = regex.compile(r"[\t-\r -~ -ɏΑ-ΡΣ-ώА-я‐-‧‰-⁞€一-龥]*")
# Pieces whose count is kept in a worker, and their greatest length: together a bound in bytes.
CACHE, KEPT = 800_000, 64
# Letters of a piece after which its table so far is kept for pieces with the same begin.
SHARED = 6
# Last letters by which the longest token that may end a prefix is looked up.
TAIL = 3


def byte_letters() -> list[str]:
    """The letter that stands for each byte: printable bytes themselves, others from U+0100 on."""
    plain = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    others = iter(range(0x100, 0x200))
    return [chr(b if b in plain else next(others)) for b in range(256)]


class PieceCounts(dict):
    """Number of tokens by piece; what is missing is worked out by the dynamic program."""

    def __init__(self, path: str):
        super().__init__()
        with open(path, encoding="utf-8") as f:
            rules = json.load(f)
        cut = rules.get("pre_tokenizer") or {}
        if rules.get("normalizer") or cut.get("type") != "ByteLevel" or cut.get("add_prefix_space") or not cut.get("use_regex", True):
            raise ValueError(f"{path} does not cut texts by the pattern of this operator")
        model = rules["model"]
        self.ranks = {tuple(m) if isinstance(m, list) else tuple(m.split(" ")): i for i, m in enumerate(model["merges"])}
        self.vocab = frozenset(model["vocab"])
        # the longest token by its last letters
        self.reach: dict[str, int] = {}
        for token in self.vocab:
            ending = token[-TAIL:]
            self.reach[ending] = max(self.reach.get(ending, TAIL), len(token))
        self.letters = byte_letters()
        self.begun: dict[str, tuple[list[int], list[str]]] = {}
        self.fits = lru_cache(200_000)(self._fits)

    def merged(self, s: str) -> list[str]:
        """The tokens of a short string by merging the pair of lowest rank again and again."""
        parts = list(s)
        while len(parts) > 1:
            rank, at = min((self.ranks.get(pair, 1 << 60), i) for i, pair in enumerate(zip(parts, parts[1:], strict=False)))
            if rank == 1 << 60:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def _fits(self, before: str, token: str) -> bool:
        return self.merged(before + token) == ([before, token] if before else [token])

    def table(self, piece: str) -> list[int]:
        """Tokens of each byte prefix of a piece, from 0 to its length."""
        return self._table("".join(map(self.letters.__getitem__, piece.encode())))[0]

    def _table(self, s: str) -> tuple[list[int], list[str]]:
        # what short prefixes have come to is shared by all pieces that begin with them
        known = SHARED if s[:SHARED] in self.begun else 0
        count, last = map(list.copy, self.begun[s[:SHARED]]) if known else ([0], [""])
        vocab, fits, reach = self.vocab, self.fits, self.reach
        for i in range(known + 1, len(s) + 1):
            longest = reach.get(s[i - TAIL : i], TAIL) if i > TAIL else i
            for j in range(i - longest if i > longest else 0, i):
                token = s[j:i]
                if token in vocab and fits(last[j], token):
                    count.append(count[j] + 1)
                    last.append(token)
                    break
            else:
                raise ValueError("a byte has no token")
            if i == SHARED:
                if len(self.begun) >= CACHE // 4:
                    self.begun.clear()
                self.begun[s[:i]] = (count.copy(), last.copy())
        return count, last

    def __missing__(self, piece: str) -> int:
        if len(self) >= CACHE:
            self.clear()
        mapped = piece if piece.isascii() and piece.isalpha() else "".join(map(self.letters.__getitem__, piece.encode()))
        n = self._table(mapped)[0][-1]
        if len(piece) <= KEPT:
            self[piece] = n
        return n


class PrefixCounter:
    """Prefix counts of texts for one vocabulary file."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        library = Tokenizer.from_file(path)
        self.cut = library.pre_tokenizer.pre_tokenize_str
        special = [t.content for t in library.get_added_tokens_decoder().values()]
        self.special = frozenset(special)
        self.split = regex.compile("(" + "|".join(map(regex.escape, sorted(special, key=len, reverse=True))) + ")") if special else None
        self.find = regex.compile(PATTERN).findall
        self.blank = regex.compile(r"\p{White_Space}+").fullmatch  # Python's own idea of white space is another
        self.one_class = regex.compile(r" ?(?:\p{L}+|\p{N}+|[^\s\p{L}\p{N}']+)")
        self.counts = PieceCounts(path)

    def alike(self, piece: str) -> bool:
        """Whether each prefix of a piece is a piece, too (but for a blank alone)."""
        return piece not in self.special and bool(SETTLED.fullmatch(piece)) and bool(self.one_class.fullmatch(piece))

    def segments(self, text: str) -> list[str]:
        """The text with the vocabulary's special strings cut out as pieces of their own."""
        if not self.split or not any(s in text for s in self.special):
            return [text]
        return [s for s in self.split.split(text) if s]

    def pieces(self, segment: str) -> list[str]:
        if segment in self.special:
            return [segment]
        if SETTLED.fullmatch(segment):
            return self.find(segment)
        return [segment[a:b] for _, (a, b) in self.cut(segment)]

    def prefix(self, text: str) -> Prefix:
        pieces, counts = [], []
        for segment in self.segments(text):
            some = self.pieces(segment)
            pieces += some
            counts += [1] if segment in self.special else map(self.counts.__getitem__, some)
        return Prefix(self, text, pieces, counts)


class Prefix:
    """Exact token count at every prefix of one text.

    The counts at piece ends are added up at once; within a piece the table of its dynamic
    program answers, which is made when first asked for and kept.
    """

    def __init__(self, counter: PrefixCounter, text: str, pieces: list[str], counts: list[int]):
        self.counter, self.text, self.pieces = counter, text, pieces
        self.ends = np.zeros(len(counts) + 1, np.int64)
        np.cumsum(counts, out=self.ends[1:])
        self.tables: dict[tuple[int, int], np.ndarray] = {}

    @property
    def total(self) -> int:
        return int(self.ends[-1])

    @cached_property
    def starts(self) -> np.ndarray:
        return np.concatenate([np.zeros(1, np.int64), np.cumsum(np.fromiter(map(len, self.pieces), np.int64, len(self.pieces)))])

    def table(self, first: int, last: int) -> np.ndarray:
        """Tokens of each character prefix of the pieces first to last, read as one piece."""
        found = self.tables.get((first, last))
        if found is None:
            piece = self.text[self.starts[first] : self.starts[last + 1]]
            counts = np.array(self.counter.counts.table(piece))
            if not piece.isascii():
                # from bytes to characters: a character begins at each byte that goes on no other
                data = np.frombuffer(piece.encode(), np.uint8)
                counts = counts[np.append(np.flatnonzero((data & 0xC0) != 0x80), len(data))]
            found = self.tables[first, last] = counts
        return found

    def run(self, i: int) -> int:
        """The first of the pieces of white space that piece i, or the blank it begins with, goes on."""
        while i and self.counter.blank(self.pieces[i - 1]):
            i -= 1
        return i

    def at(self, chars: int) -> int:
        """Tokens of ``text[:chars]``.

        Letters, digits or marks that are cut are still one piece, and white space at the end is
        one piece with what is before it; a special string or contraction cut short is cut anew.
        """
        i = min(int(np.searchsorted(self.starts, chars, side="right")) - 1, len(self.pieces))
        if i >= len(self.pieces):
            return self.total
        within = chars - int(self.starts[i])
        piece = self.pieces[i]
        if within and self.counter.alike(piece) and not (within == 1 and piece[0] == " "):
            return int(self.ends[i] + self.table(i, i)[within])
        begin = self.run(i)
        blank = within + int(self.starts[i] - self.starts[begin])
        if blank and (not within or self.counter.blank(self.text[self.starts[i] : chars])) and self.pieces[begin] not in self.counter.special:
            if not within:
                return int(self.ends[begin] + self.table(begin, i - 1)[blank])
            if self.counter.blank(piece) or piece[0] == " ":
                return int(self.ends[begin] + self._blanks(begin, i)[blank])
        return self._anew(begin, chars)

    def _blanks(self, first: int, i: int) -> np.ndarray:
        """The table of a run of white space that ends in piece i, or in the blank that i begins with."""
        if self.counter.blank(self.pieces[i]):
            return self.table(first, i)
        found = self.tables.get((first, -i - 1))
        if found is None:
            # white space is ASCII or counts by its own characters' bytes: one blank more goes to the table's end
            piece = self.text[self.starts[first] : self.starts[i] + 1]
            data = np.frombuffer(piece.encode(), np.uint8)
            counts = np.array(self.counter.counts.table(piece))
            found = self.tables[first, -i - 1] = counts[np.append(np.flatnonzero((data & 0xC0) != 0x80), len(data))]
        return found

    def _anew(self, i: int, chars: int) -> int:
        # A cut special string, and a mark just before it, read as one run of marks.
        if i and self.pieces[i] in self.counter.special and self.pieces[i - 1] not in self.counter.special:
            i = self.run(i - 1)
        rest = self.text[self.starts[i] : chars]
        return int(self.ends[i]) + sum(1 if s in self.counter.special else sum(map(self.counter.counts.__getitem__, self.counter.pieces(s))) for s in self.counter.segments(rest))

    def fit(self, budget: int) -> int:
        """The most characters whose prefix has at most ``budget`` tokens, looking back from the first pieces beyond it.

        A piece that is cut as one is searched in its table at once.
        """
        i = min(int(np.searchsorted(self.ends, budget, side="right")) + 1, len(self.pieces) - 1)
        if self.total <= budget:
            return len(self.text)
        while i >= 0:
            first, end = int(self.starts[i]), int(self.starts[i + 1])
            if self.counter.alike(self.pieces[i]):
                fine = np.flatnonzero(self.ends[i] + self.table(i, i) <= budget)
                least = 2 if self.pieces[i][0] == " " else 1
                if len(fine) and fine[-1] >= least and fine[-1] < end - first:
                    return first + int(fine[-1])
                tries = range(first + least - 1, first - 1, -1)
                if int(self.at(end)) <= budget:
                    return end
            elif self.counter.blank(self.pieces[i]):
                counts = self.ends[self.run(i)] + self.table(self.run(i), i)
                skip = first - int(self.starts[self.run(i)])
                fine = np.flatnonzero(counts[skip:] <= budget)
                if int(self.at(end)) <= budget:
                    return end
                fine = fine[fine < end - first]
                if len(fine):
                    return first + int(fine[-1])
                i -= 1
                continue
            else:
                tries = range(end, first - 1, -1)
            for chars in tries:
                if self.at(chars) <= budget:
                    return chars
            i -= 1
        return 0


def counter(path: str) -> PrefixCounter:
    """One counter, with its cache, per worker process."""
    return per_process(("prefix_tokens", path), lambda: PrefixCounter(path))


def token_counts(docs: DataFrame, path: str, limit: int = 512, budget: int | None = None) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit of every row; with ``budget`` also fit_chars, the longest prefix within it.

    A null text counts as empty: no bytes, no tokens.  Rows with a null or repeated
    doc_id are counted one by one.  Other columns are ignored.  Long texts are counted
    whole, in time linear in their length, one piece at a time.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = counter(path)
        for batch in batches:
            for part in slices(batch, "text"):
                total, fits, size = [], [], []
                for text in texts(part, "text"):
                    prefix = own.prefix(text)
                    total.append(prefix.total)
                    size.append(len(text.encode()))
                    if budget is not None:
                        fits.append(prefix.fit(budget))
                columns = {
                    "doc_id": part.column("doc_id"),
                    "n_bytes": pa.array(size, pa.int64()),
                    "n_tokens": pa.array(total, pa.int64()),
                    "over_limit": pa.array([n > limit for n in total], pa.bool_()),
                }
                if budget is not None:
                    columns["fit_chars"] = pa.array(fits, pa.int64())
                yield pa.RecordBatch.from_pydict(columns)

    schema = "doc_id long, n_bytes long, n_tokens long, over_limit boolean" + (", fit_chars long" if budget is not None else "")
    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return slim.mapInArrow(count, schema)
