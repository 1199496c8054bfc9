"""Items that contain a reference passage with few edits: pigeonhole pieces and bit-parallel verification.

With at most k edits, one of k + 1 pieces of a passage is left as it was. Each passage is cut into
``budget + 1`` pieces; one automaton over the pieces of a block of passages finds exact hits in the
normalised text, and each hit fixes the stretch of text where the passage could lie. Stretches of one passage
that overlap are merged and verified with Myers' bit-parallel distance, which gives the least number of
edits between the whole passage and any substring.

The passages are the query set: they are taken in blocks of bounded bytes, and each block is one pass over
the items without any shuffle, so a passage that very many items contain costs nothing extra. Nothing is kept of
the items but their hits.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Edits allowed per 100 characters of a passage, and normalised bytes of passages that share one pass.
ERROR_PERCENT, BLOCK_BYTES = 8, 2_000_000
FIELDS = "item_id long, passage_id long, distance int, start long, end long"


def normal(text: str) -> str:
    """Lower case, one blank for any white space."""
    return " ".join(text.lower().split())


def pieces(passage: str, budget: int) -> list[tuple[int, str]]:
    """(offset, piece) of ``budget + 1`` pieces of nearly equal length."""
    n = budget + 1
    cuts = [len(passage) * k // n for k in range(n + 1)]
    return [(a, passage[a:b]) for a, b in zip(cuts, cuts[1:], strict=False)]


class Myers:
    """Edit distance of one pattern to the substrings of a text, a machine word of any length at a time."""

    def __init__(self, pattern: str):
        self.size, self.full, self.high = len(pattern), (1 << len(pattern)) - 1, 1 << (len(pattern) - 1)
        self.at: dict[str, int] = {}
        for k, c in enumerate(pattern):
            self.at[c] = self.at.get(c, 0) | (1 << k)

    def best(self, text: str) -> tuple[int, int]:
        """(least distance, first end of a substring that has it); the empty substring ends at 0."""
        plus, minus, score = self.full, 0, self.size
        least, end, find = score, 0, self.at.get
        for k, c in enumerate(text, 1):
            eq = find(c, 0)
            xv = eq | minus
            xh = (((eq & plus) + plus) ^ plus) | eq
            up = minus | (self.full & ~(xh | plus))
            down = plus & xh
            if up & self.high:
                score += 1
            elif down & self.high:
                score -= 1
            up, down = (up << 1) & self.full, (down << 1) & self.full
            plus, minus = down | (self.full & ~(xv | up)), up & xv
            if score < least:
                least, end = score, k
        return least, end


class Passages:
    """A block of passages with the automaton of their pieces."""

    def __init__(self, rows: list[tuple[int, str]], percent: int):
        import ahocorasick

        self.rows = [(i, t, len(t) * percent // 100) for i, t in rows]
        self.automaton, filed = ahocorasick.Automaton(), {}
        for k, (_, text, budget) in enumerate(self.rows):
            for offset, piece in pieces(text, budget):
                filed.setdefault(piece, []).append((k, offset))
        for piece, places in filed.items():
            self.automaton.add_word(piece, (len(piece), places))
        self.automaton.make_automaton()
        self.forward: dict[int, Myers] = {}
        self.backward: dict[int, Myers] = {}

    def search(self, text: str) -> Iterator[tuple[int, int, int, int]]:
        """(passage id, distance, start, end) of every passage with a substring within its budget; best one each."""
        near: dict[int, list[tuple[int, int]]] = {}
        for last, (size, places) in self.automaton.iter(text):
            for k, offset in places:
                _, passage, budget = self.rows[k]
                lo = last + 1 - size - offset - budget
                spans = near.setdefault(k, [])
                if spans and lo <= spans[-1][1] and lo >= spans[-1][0]:
                    spans[-1] = spans[-1][0], max(spans[-1][1], lo + len(passage) + 2 * budget)
                else:
                    spans.append((lo, lo + len(passage) + 2 * budget))
        for k, spans in near.items():
            passage_id, passage, budget = self.rows[k]
            found = None
            for lo, hi in sorted(set(spans)):
                lo, hi = max(0, lo), min(len(text), hi)
                if hi - lo < len(passage) - budget:
                    continue
                place = text.find(passage, lo, hi)
                if place >= 0:
                    mine = (0, place, place + len(passage))
                else:
                    mine = self._verify(k, text[lo:hi], lo, budget)
                if mine and (found is None or mine < found):
                    found = mine
            if found:
                yield passage_id, *found

    def _verify(self, k: int, window: str, lo: int, budget: int) -> tuple[int, int, int] | None:
        passage = self.rows[k][1]
        if k not in self.forward:
            self.forward[k] = Myers(passage)
        least, end = self.forward[k].best(window)
        if least > budget:
            return None
        if k not in self.backward:
            self.backward[k] = Myers(passage[::-1])
        back = self.backward[k].best(window[:end][::-1][:len(passage) + least])
        return least, lo + end - back[1], lo + end


def blocks(passages: DataFrame) -> Iterator[list[tuple[int, str]]]:
    """The normalised, non-empty passages in blocks of at most ``BLOCK_BYTES`` (one passage at least)."""
    held: list[tuple[int, str]] = []
    size = 0
    rows = passages.filter("passage_id is not null and text is not null").select(F.col("passage_id").cast("long"), F.col("text").cast("string")).distinct()
    for row in rows.toLocalIterator():
        text = normal(row[1])
        if not text:
            continue
        if held and size + len(text.encode()) > BLOCK_BYTES:
            yield held
            held, size = [], 0
        held.append((row[0], text))
        size += len(text.encode())
    if held:
        yield held


def leaked_passages(items: DataFrame, passages: DataFrame, error_percent: int = ERROR_PERCENT) -> DataFrame:
    """``item_id, passage_id, distance, start, end``: passages found in the items' whole descriptions.

    ``passages`` has ``passage_id`` and ``text``; the catalog has no such records of its own, so any table of held-out
    texts serves. Texts are compared in lower case with one blank for white space, and ``start`` and ``end`` count
    characters of that form. A passage is found if a substring is within ``error_percent`` edits per 100
    characters; the row has the least distance (ties: the first). Null, empty and blank texts and
    null passage ids match nothing; a passage id with several texts is found through any, once per text.
    Repeated item rows are answered each; a null item id is kept. Other columns are not looked at.
    """
    spark = items.sparkSession
    texts = items.select(F.col("item_id").cast("long"), F.col("description").cast("string"))
    out = None
    for block in blocks(passages):
        shared = spark.sparkContext.broadcast(block)

        def run(batches: Iterator[pd.DataFrame], shared=shared) -> Iterator[pd.DataFrame]:
            finder = Passages(shared.value, error_percent)
            for batch in batches:
                rows = [(item, *hit) for item, text in zip(batch["item_id"], batch["description"], strict=True) if text for hit in finder.search(normal(text))]
                yield pd.DataFrame(rows, columns=["item_id", "passage_id", "distance", "start", "end"])

        found = texts.mapInPandas(run, FIELDS)
        out = found if out is None else out.unionByName(found)
    return spark.createDataFrame([], FIELDS) if out is None else out


def clean_items(items: DataFrame, passages: DataFrame, error_percent: int = ERROR_PERCENT) -> DataFrame:
    """The rows of ``items`` in which ``leaked_passages`` finds nothing, all columns kept.

    Rows are judged one by one, so repeated rows go or stay together and a null item id does no harm.
    """
    spark = items.sparkSession
    clean = F.lit(True)
    for block in blocks(passages):
        clean = clean & _none_of(spark.sparkContext.broadcast(block), error_percent)(F.col("description").cast("string"))
    return items.filter(clean)


def _none_of(shared, error_percent: int):
    @F.pandas_udf("boolean")
    def none_of(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        finder = Passages(shared.value, error_percent)
        for batch in batches:
            yield pd.Series([not text or next(finder.search(normal(text)), None) is None for text in batch])

    return none_of
