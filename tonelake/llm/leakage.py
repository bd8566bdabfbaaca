"""Evaluation texts leaking into training text: pigeonhole edit matching over words.

A passage of an item counts if EXACT words in a row appear, or if LOOSE or more words appear with at most one word in
six changed, missing or added. Any such loose passage holds one of the windows of WINDOWS (length, error budget), so
the windows at all places of an item are searched. A window with budget e is cut into e + 1 pieces, of which one must
appear unchanged; all windows' pieces hold a run of PIECE words, so the index has each run of PIECE words at all
places. Documents are scanned once against it. Around the hits, all items that share them are asked at once which of
them have a window whose words mostly occur there; so pieces shared by many items (boilerplate) cost one array
operation, not one comparison per item. What is left is verified by Myers' bit-parallel edit distance over words, for
all places of a window length at once (one 64-bit lane per place). Both bounds drop nothing that could match.

The items are the stated query set: they are broadcast in blocks of at most `block` items, and `resident` blocks share
one scan, so what is broadcast and held is bounded whatever their number. Documents are neither shuffled nor cut.

Defined results: null, empty and blank texts and items match nothing; items shorter than EXACT words match nothing;
repeated documents and items give a row each; ties do not arise; each (document, item) pair is reported once per
document row, with the kind of match and its errors; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections import defaultdict
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tonelake.llm.folding import words
from tonelake.sources.tables import text_rows

EXACT, LOOSE, PIECE = 14, 22, 4
#: (words, errors): L words with floor(L / 6) errors. Longer passages split into two of these.
WINDOWS = ((22, 3), (24, 4), (30, 5), (36, 6), (42, 7))
#: Item words that unchanged runs of PIECE words must cover: in the window (24, 4), 20 kept words fall into 5 runs, of which four may be shorter than PIECE.
COVERED = 8
#: Items of one broadcast, and broadcasts whose items a worker holds at once: one scan serves 100,000 items.
ITEM_BLOCK, RESIDENT = 5_000, 20
#: Words of a text compared with an item at once.
STRETCH = 4_000


class Item:
    def __init__(self, item_id: int, tokens: list[str]):
        self.item_id, self.tokens = item_id, tokens
        self.codes: dict[str, int] = {}
        self.coded = np.array([self.codes.setdefault(t, len(self.codes)) for t in tokens], dtype=np.int32)
        self._masks: dict[int, dict[str, np.ndarray]] = {}

    def masks(self, length: int) -> dict[str, np.ndarray]:
        """For each word the bits of its places in the window that begins at each place of the item."""
        if length not in self._masks:
            starts = len(self.tokens) - length + 1
            out: dict[str, np.ndarray] = defaultdict(lambda: np.zeros(starts, dtype=np.uint64))
            for s in range(starts):
                for k in range(length):
                    out[self.tokens[s + k]][s] |= np.uint64(1 << k)
            self._masks[length] = dict(out)
        return self._masks[length]


def least_errors(item: Item, length: int, text: list[str], enough: int) -> int:
    """Least edit distance of any window of `length` item words to any stretch of `text` (stops at `enough` or less)."""
    starts = len(item.tokens) - length + 1
    if starts < 1:
        return length
    masks, one, top = item.masks(length), np.uint64(1), np.uint64(length - 1)
    nothing = np.zeros(starts, dtype=np.uint64)
    plus, minus = np.full(starts, 0xFFFFFFFFFFFFFFFF, dtype=np.uint64), nothing.copy()
    score, least = np.full(starts, length, dtype=np.int64), length
    for t in text:
        eq = masks.get(t, nothing)
        xv = eq | minus
        xh = (((eq & plus) + plus) ^ plus) | eq
        up, down = minus | ~(xh | plus), plus & xh
        score += ((up >> top) & one).astype(np.int64)
        score -= ((down >> top) & one).astype(np.int64)
        up, down = up << one, down << one
        plus, minus = down | ~(xv | up), up & xv
        now = int(score.min())
        if now < least:
            least = now
            if least <= enough:
                break
    return least


def _may_cover(places: list[tuple[int, int]]) -> bool:
    """Whether piece hits on diagonals as near as a window's budget allows cover COVERED item words."""
    if len(places) + PIECE - 1 < COVERED and len({p for _, p in places}) * PIECE < COVERED:
        return False
    by_diagonal: dict[int, set[int]] = defaultdict(set)
    for q, p in places:
        by_diagonal[q - p].update(range(p, p + PIECE))
    widest = WINDOWS[-1][1]
    diagonals = sorted(by_diagonal)
    for k, d in enumerate(diagonals):
        covered: set[int] = set()
        for e in diagonals[k:]:
            if e > d + widest:
                break
            covered |= by_diagonal[e]
            if len(covered) >= COVERED:
                return True
    return False


def enough_kept(item: Item, text: list[str]) -> list[tuple[int, int]]:
    """The window sizes of which some place keeps enough words: on diagonals within the budget, at least length - budget item words appear."""
    n, m = len(item.tokens), len(text)
    codes = item.codes
    a = item.coded
    b = np.full(m + 2 * n, -1, dtype=np.int32)
    b[n : n + m] = [codes.get(t, -1) for t in text]
    # same[p, k]: item word p equals the text word at p + k - n
    same = np.lib.stride_tricks.sliding_window_view(b, m + n)[:n] == a[:, None]
    out = []
    for length, budget in WINDOWS:
        if length > n:
            break
        near = same[:, budget:].copy()
        for k in range(budget):
            near |= same[:, k : k + near.shape[1]]
        kept = np.cumsum(near, axis=0, dtype=np.int16)
        most = kept[length - 1 :].copy()
        most[1:] -= kept[:-length]
        if most.max() >= length - budget:
            out.append((length, budget))
    return out


class Matcher:
    """The piece index of the items, asked once per stretch of a text for all items together."""

    def __init__(self, items: list[tuple[int, str]]):
        self.items: list[Item] = []
        self.vocabulary: dict[str, int] = {}
        at: dict[tuple[str, ...], list[tuple[int, int]]] = defaultdict(list)
        for item_id, text in items:
            tokens = words(text)
            if len(tokens) < EXACT:
                continue
            for p in range(len(tokens) - PIECE + 1):
                at[tuple(tokens[p : p + PIECE])].append((len(self.items), p))
            self.items.append(Item(item_id, tokens))
        self.piece = {g: k for k, g in enumerate(at)}
        self.postings = [np.array(v, dtype=np.int32).T for v in at.values()]
        codes = [[self.vocabulary.setdefault(t, len(self.vocabulary)) for t in i.tokens] for i in self.items]
        self.flat = np.array([c for one in codes for c in one], dtype=np.int32)
        self.lengths = np.array([len(one) for one in codes], dtype=np.int64)
        self.begins = np.concatenate([[0], np.cumsum(self.lengths)])[:-1] if codes else np.zeros(0, dtype=np.int64)

    def _holding(self, candidates: np.ndarray, stretch: list[str]) -> np.ndarray:
        """Those of the candidate items of which some window's words mostly occur in the stretch, in whatever order: a bound that any match satisfies."""
        get = self.vocabulary.get
        present = np.zeros(len(self.vocabulary) + 1, dtype=bool)
        present[[get(t, -1) for t in stretch]] = True
        present[-1] = False
        lengths = self.lengths[candidates]
        ends = np.cumsum(lengths)
        total = int(ends[-1])
        place = np.arange(total) + np.repeat(self.begins[candidates] - (ends - lengths), lengths)
        owner = np.repeat(np.arange(len(candidates)), lengths)
        kept = np.concatenate([[0], np.cumsum(present[self.flat[place]])])
        good = np.zeros(len(candidates), dtype=bool)
        for length, budget in ((EXACT, 0), *WINDOWS):
            if length > total:
                break
            enough = (kept[length:] - kept[:-length] >= length - budget) & (owner[length - 1 :] == owner[: total - length + 1])
            good[owner[: total - length + 1][enough]] = True
        return candidates[good]

    def match(self, text: str | None) -> list[tuple[int, str, int]]:
        """(item_id, kind, errors) of the items that the text shows."""
        tokens = words(text)
        get = self.piece.get
        hits = [(q, k) for q, k in enumerate(map(get, zip(*(tokens[k:] for k in range(PIECE))))) if k is not None]
        if not hits:
            return []
        # stretches of the text around the hits, of bounded length; a window reaches at most its length and budget beyond a hit
        reach = WINDOWS[-1][0] + WINDOWS[-1][1]
        stretches: list[list] = []
        for q, k in hits:
            if stretches and q - reach <= stretches[-1][1]:
                stretches[-1][1] = q + PIECE + reach
                stretches[-1][2].append((q, k))
            else:
                stretches.append([max(0, q - reach), q + PIECE + reach, [(q, k)]])
        found: dict[int, tuple[str, int]] = {}
        for begin, end, inside in stretches:
            step = STRETCH - 2 * reach
            for b in range(begin, max(begin + 1, end - 2 * reach), step):
                e = min(b + STRETCH, end)
                here = [(q, k) for q, k in inside if b <= q and q + PIECE <= e] if end - begin > STRETCH else inside
                if len(here) + PIECE - 1 < COVERED and len(here) * PIECE < COVERED:
                    continue
                candidates = np.unique(np.concatenate([self.postings[k][0] for k in {k for _, k in here}]))
                holding = self._holding(candidates, tokens[b:e])
                if not len(holding):
                    continue
                chosen = np.zeros(len(self.items), dtype=bool)
                chosen[holding] = True
                places: dict[int, list[tuple[int, int]]] = defaultdict(list)
                for q, k in here:
                    who, where = self.postings[k]
                    for i, p in zip(who[chosen[who]].tolist(), where[chosen[who]].tolist()):
                        places[i].append((q - b, p))
                for i, at in places.items():
                    if found.get(i, ("", 0))[0] != "exact":
                        one = self._verify(self.items[i], at, tokens[b:e])
                        if one and (i not in found or one[0] == "exact"):
                            found[i] = one
        return [(self.items[i].item_id, *f) for i, f in sorted(found.items())]

    @staticmethod
    def _verify(item: Item, places: list[tuple[int, int]], tokens: list[str]) -> tuple[str, int] | None:
        runs: dict[int, tuple[int, int]] = {}  # per diagonal: last place and run length, since places come in order
        for q, p in places:
            last, n = runs.get(q - p, (-2, 0))
            n = n + 1 if last == q - 1 else 1
            runs[q - p] = (q, n)
            if n >= EXACT - PIECE + 1:
                return "exact", 0
        if len(item.tokens) < LOOSE or not _may_cover(places):
            return None
        for length, budget in enough_kept(item, tokens):
            errors = least_errors(item, length, tokens, budget)
            if errors <= budget:
                return "loose", errors
        return None


_MATCHERS: dict[str, Matcher] = {}


def shared_matcher(key: str, blocks: list) -> Matcher:
    """One matcher per worker and content of the items; the last one only."""
    if key not in _MATCHERS:
        _MATCHERS.clear()
        _MATCHERS[key] = Matcher([row for b in blocks for row in b.value])
    return _MATCHERS[key]


def leaks(docs: DataFrame, doc_id: str, text: str, items: DataFrame, item_id: str, item_text: str, block: int = ITEM_BLOCK, resident: int = RESIDENT) -> DataFrame:
    """(doc_id, item_id, kind, errors) of every document that shows a passage of an item."""
    spark = docs.sparkSession
    asked = items.select(F.col(item_id).cast("bigint").alias("item_id"), F.col(item_text).cast("string").alias("item_text")).where("item_id is not null and item_text is not null")
    rows = docs.select(F.col(doc_id).cast("bigint").alias("doc_id"), F.col(text).cast("string").alias("text"))
    schema = pa.schema([("doc_id", pa.int64()), ("item_id", pa.int64()), ("kind", pa.string()), ("errors", pa.int32())])

    def scan(sent: list, key: str) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            matcher = shared_matcher(key, sent)
            for batch in text_rows(batches):
                out = [(d.as_py(), *m) for d, t in zip(batch.column(0), batch.column(1)) for m in matcher.match(t.as_py())]
                yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], f.type) for i, f in enumerate(schema)], schema=schema)

        return rows.mapInArrow(run, "doc_id bigint, item_id bigint, kind string, errors int")

    parts, held, sent, digest = [], [], [], hashlib.sha256()
    # the stated query set, block by block: a block at a time is on the driver; `resident` blocks share one scan and one folding of the corpus
    for row in asked.toLocalIterator():
        held.append((row["item_id"], row["item_text"]))
        digest.update(repr(held[-1]).encode("utf-8", "surrogatepass"))
        if len(held) == block:
            sent.append(spark.sparkContext.broadcast(held))
            held = []
            if len(sent) == resident:
                parts.append(scan(sent, digest.hexdigest()))
                sent, digest = [], hashlib.sha256()
    if held or sent or not parts:
        parts.append(scan([*sent, spark.sparkContext.broadcast(held)], digest.hexdigest()))
    return reduce(DataFrame.unionByName, parts)
