"""Pages by intervals: requests and edits as runs of page numbers with their place in the output, and pages placed once by a join.

Nothing here has a row or an array entry for each page asked for: a run of any length is one row, and one more for each
4096 pages where it meets the pages.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BLOCK = 4096  # pages


def run_length(runs: Column) -> Column:
    """How many pages runs (array<struct<lo, hi>>) have."""
    return F.aggregate(runs, F.lit(0).cast("long"), lambda n, r: n + r["hi"] - r["lo"] + 1)


def with_places(runs: Column) -> Column:
    """runs as array<struct<lo, hi, before>>: how many pages come before each."""
    empty = F.struct(F.lit(0).cast("long").alias("n"), F.array().cast("array<struct<lo:bigint,hi:bigint,before:bigint>>").alias("out"))
    add = lambda s, r: F.struct((s["n"] + r["hi"] - r["lo"] + 1).alias("n"), F.concat(s["out"], F.array(F.struct(r["lo"].alias("lo"), r["hi"].alias("hi"), s["n"].alias("before")))).alias("out"))
    return F.aggregate(runs, empty, add)["out"]


def merged(runs: Column) -> Column:
    """The different pages of runs as runs, ascending."""
    run = lambda lo, hi: F.struct(lo.alias("lo"), hi.alias("hi"))
    kind = "array<struct<lo:bigint,hi:bigint>>"

    def add(s: Column, r: Column) -> Column:
        apart = r["lo"] > s["hi"] + 1
        out = F.when(apart & (s["hi"] > 0), F.concat(s["out"], F.array(run(s["lo"], s["hi"])))).otherwise(s["out"])
        return F.struct(F.when(apart, r["lo"]).otherwise(s["lo"]).alias("lo"), F.greatest(r["hi"], s["hi"]).alias("hi"), out.alias("out"))

    start = F.struct(F.lit(0).cast("long").alias("lo"), F.lit(-1).cast("long").alias("hi"), F.array().cast(kind).alias("out"))
    return F.aggregate(F.array_sort(runs), start, add, lambda s: F.when(s["hi"] > 0, F.concat(s["out"], F.array(run(s["lo"], s["hi"])))).otherwise(s["out"]))


def placed(pages: DataFrame, runs: DataFrame) -> DataFrame:
    """runs (doc_id, lo, hi, before, ...) with the pages (doc_id, page_no, ...) they name, and out_page: before plus the page's place in its run.

    Runs meet pages by document and block of pages, so one long document is many tasks. Pages that aren't there leave a gap.
    """
    runs = runs.withColumn("_b", F.explode(F.sequence(F.call_function("div", F.col("lo"), F.lit(BLOCK)), F.call_function("div", F.col("hi"), F.lit(BLOCK)))))
    there = pages.withColumn("_b", F.call_function("div", F.col("page_no").cast("long"), F.lit(BLOCK)))
    out = runs.join(there, ["doc_id", "_b"]).where("page_no between lo and hi")
    return out.withColumn("out_page", (F.col("before") + F.col("page_no") - F.col("lo") + 1).cast("int")).drop("_b", "lo", "hi", "before")


class Pieces:
    """A document's pages as pieces (first page, pages, turn), in order. An edit looks at one group of pieces, not at pages.

    Pieces are in groups of some hundreds with the number of pages in each, so an edit of a document with n pieces takes about the root of n steps.
    """

    GROUP = 256

    def __init__(self, total: int):
        self.groups = [[(1, total, 0)]] if total > 0 else [[]]
        self.sizes = [total]

    def __len__(self) -> int:
        return sum(self.sizes)

    def _find(self, index: int) -> tuple[int, int, int]:
        """(group, piece, place in it) of the page at an index."""
        g = 0
        while index >= self.sizes[g]:
            index -= self.sizes[g]
            g += 1
        i = 0
        while index >= self.groups[g][i][1]:
            index -= self.groups[g][i][1]
            i += 1
        return g, i, index

    def _changed(self, g: int) -> None:
        pieces = self.groups[g]
        parts = [pieces[i : i + self.GROUP] for i in range(0, len(pieces), self.GROUP)] if len(pieces) > 2 * self.GROUP else [pieces]
        if len(parts) > 1 or pieces or len(self.groups) == 1:
            self.groups[g : g + 1], self.sizes[g : g + 1] = parts, [sum(p[1] for p in x) for x in parts]
        else:
            del self.groups[g], self.sizes[g]

    def take(self, index: int) -> tuple[int, int, int]:
        """Takes the page at an index out."""
        g, i, k = self._find(index)
        first, n, turn = self.groups[g][i]
        rest = [(first, k, turn), (first + k + 1, n - k - 1, turn)]
        self.groups[g][i : i + 1] = [p for p in rest if p[1]]
        self._changed(g)
        return first + k, 1, turn

    def put(self, index: int, piece: tuple[int, int, int]) -> None:
        """Puts a page before the index; at the end if that is the number of pages."""
        if index == len(self):
            self.groups[-1].append(piece)
            self._changed(len(self.groups) - 1)
            return
        g, i, k = self._find(index)
        first, n, turn = self.groups[g][i]
        self.groups[g][i : i + 1] = [p for p in [(first, k, turn), piece, (first + k, n - k, turn)] if p[1]]
        self._changed(g)

    def apply(self, op: str, at: int, to: int | None) -> None:
        """remove, duplicate; rotate by `to` degrees; move to index `to`; swap with the neighbour `to` (-1 or 1) further. An index outside changes nothing."""
        n = len(self)
        other = at + (to or 0) if op == "swap" else to
        if at is None or not 0 <= at < n or (op in ("move", "swap") and (other is None or not 0 <= other < n)):
            return
        if op == "remove":
            self.take(at)
        elif op == "rotate":
            first, _, turn = self.take(at)
            self.put(at, (first, 1, (turn + (to or 0)) % 360))
        elif op == "duplicate":
            g, i, k = self._find(at)
            first, _, turn = self.groups[g][i]
            self.put(at + 1, (first + k, 1, turn))
        elif op in ("move", "swap"):
            self.put(other, self.take(at))

    def rows(self) -> Iterator[tuple[int, int, int, int]]:
        """(first page, last page, pages before, turn); neighbours that continue each other are one."""
        before, held = 0, None
        for first, n, turn in (p for g in self.groups for p in g):
            if held and held[0] + held[1] == first and held[2] == turn:
                held = (held[0], held[1] + n, turn)
                continue
            if held:
                yield held[0], held[0] + held[1] - 1, before, held[2]
                before += held[1]
            held = (first, n, turn)
        if held:
            yield held[0], held[0] + held[1] - 1, before, held[2]


def edited_runs(edits: DataFrame, totals: DataFrame) -> DataFrame:
    """(doc_id, lo, hi, before, turn): what documents of totals (doc_id, total_pages) are after edits (doc_id, seq, op, at, to), in the order of seq.

    Documents are sorted with their edits and passed along, none is gathered: what is held are the pieces of one document. Edits
    of unknown documents, and those without doc_id, are passed over.
    """
    known = totals.where("doc_id is not null").select("doc_id", F.lit(None).cast("long").alias("seq"), F.lit("open").alias("op"), F.col("total_pages").cast("long").alias("at"), F.lit(None).cast("long").alias("to"))
    every = known.unionByName(edits.where("doc_id is not null and seq is not null").select("doc_id", F.col("seq").cast("long").alias("seq"), "op", F.col("at").cast("long").alias("at"), F.col("to").cast("long").alias("to")))
    schema = f"doc_id {totals.schema['doc_id'].dataType.simpleString()}, lo long, hi long, before long, turn int"

    def fold(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        doc, now = None, None
        told = lambda: pd.DataFrame([(doc, *r) for r in now.rows()], columns=["doc_id", "lo", "hi", "before", "turn"])
        for pdf in it:
            for d, op, at, to in zip(pdf["doc_id"], pdf["op"], pdf["at"], pdf["to"], strict=True):
                if op == "open":
                    if now is not None:
                        yield told()
                    doc, now = d, Pieces(int(at))
                elif now is not None and d == doc:
                    now.apply(op, None if pd.isna(at) else int(at), None if pd.isna(to) else int(to))
        if now is not None:
            yield told()

    return every.repartition("doc_id").sortWithinPartitions("doc_id", F.col("seq").asc_nulls_first()).mapInPandas(fold, schema)


def edited(pages: DataFrame, edits: DataFrame) -> DataFrame:
    """pages (doc_id, page_no, rotation, ...) after all edits (doc_id, seq, op, at, to), with page_no and rotation new: see Pieces.apply for what edits do.

    However many edits there are, pages move once: edits fold over intervals of pages, and pages are placed by those. A
    document without edits stays as it is, one whose pages are all removed is gone; pages are numbered from 1 without gaps before.
    """
    totals = pages.groupBy("doc_id").agg(F.count("*").alias("total_pages"))
    out = placed(pages, edited_runs(edits, totals))
    turned = F.pmod(F.coalesce("rotation", F.lit(0)) + F.col("turn"), F.lit(360)).cast("int")
    return out.withColumn("rotation", turned).withColumn("page_no", F.col("out_page")).select(*pages.columns)
