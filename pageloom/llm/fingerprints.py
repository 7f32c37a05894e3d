"""Fingerprints of texts as invertible Bloom lookup sketches of their paragraphs, with DataFrame functions only.

A sketch has three tables of `size` cells. A paragraph's digest goes to one cell of each, where digests are counted and
xor-ed, together with a check that no xor of several digests has. Two texts' sketches subtract cell by cell: what they share
vanishes, and cells left with one digest are peeled, which empties others, until all digests in which the texts differ are
recovered. A fingerprint has 8 cells a table. For a comparison, cells are rows, a table four times as many as two texts have digests, of
which only those that don't cancel exist; a few rounds of peeling follow, one table at a time, so that no digest is peeled
twice. If cells are left, the pair is tried again with larger sketches: digests are dealt to shards, a sketch for
each shard, and a shard that fails gets twice the cells.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .common import checkpointed

SIZE = 8  # cells of each of the three tables of a fingerprint
_PIECE = 100  # code points; longer paragraphs are cut
_PER_SHARD = 8
_ROUNDS = 16  # of a larger sketch, within a row
_TURNS = 4  # of cells as rows
_BITS = 20  # of a digest's 60 bits place it in each table
# The largest primes below 2 ** 31, by which digests are checked and dealt.
_PRIMES = (2147483647, 2147483629)


def paragraphs(text: Column) -> Column:
    """The different paragraphs of a text: what stands between newlines, cut every 100 code points; empty ones are left out."""
    cut = F.regexp_replace(F.coalesce(text, F.lit("")), f"([^\\n]{{{_PIECE}}})", "$1\n")
    return F.array_distinct(F.array_remove(F.split(cut, "\n", -1), ""))


def digests(text: Column) -> Column:
    """60 bits of the MD5 of each paragraph."""
    return F.transform(paragraphs(text), lambda p: F.conv(F.substring(F.md5(p), 1, 15), 16, 10).cast("long"))


def _check(k: Column) -> Column:
    return (k % _PRIMES[0]) * (k % _PRIMES[1])


def _place(k: Column, table: int, size: Column) -> Column:
    """The cell of a table that a digest goes to: by bits of its own for each table, so that one says nothing of the others."""
    return F.shiftright(k, _BITS * table).bitwiseAND((1 << _BITS) - 1) % size


def _let(value: Column, then) -> Column:
    """then(value), with value computed once."""
    return F.transform(F.array(value), then)[0]


def _cell(n: Column, k: Column, c: Column) -> Column:
    return F.struct(n.alias("n"), k.alias("k"), c.alias("c"))


def sketch(keys: Column, size: Column) -> Column:
    """array<struct<n, k, c>> of 3 * size cells."""
    empty = _cell(F.lit(0), F.lit(0).cast("long"), F.lit(0).cast("long"))

    def table(j: int) -> Column:
        mine = lambda i: F.filter(keys, lambda k: _place(k, j, size) == i)
        return F.transform(F.sequence(F.lit(0), size - 1), lambda i: F.aggregate(mine(i), empty, lambda s, k: _cell(s["n"] + 1, s["k"].bitwiseXOR(k), s["c"].bitwiseXOR(_check(k)))))

    return F.concat(*[table(j) for j in range(3)])


def subtracted(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: _cell(x["n"] - y["n"], x["k"].bitwiseXOR(y["k"]), x["c"].bitwiseXOR(y["c"])))


def peeled(cells: Column, size: Column) -> Column:
    """struct(found array<struct<k, n>>, ok): the digests of a difference, n 1 if the first text alone has one and -1 if the second; ok if none is left."""
    single = lambda cells: F.array_distinct(F.transform(F.filter(cells, lambda x: (F.abs(x["n"]) == 1) & (_check(x["k"]) == x["c"])), lambda x: F.struct(x["k"].alias("k"), x["n"].alias("n"))))

    def without(x: Column, i: Column, out: Column) -> Column:
        place = lambda k: F.when(i < size, _place(k, 0, size)).when(i < 2 * size, _place(k, 1, size) + size).otherwise(_place(k, 2, size) + 2 * size)
        return F.aggregate(F.filter(out, lambda p: place(p["k"]) == i), x, lambda s, p: _cell(s["n"] - p["n"], s["k"].bitwiseXOR(p["k"]), s["c"].bitwiseXOR(_check(p["k"]))))

    def step(s: Column, _: Column) -> Column:
        more = lambda out: F.struct(F.transform(s["cells"], lambda x, i: without(x, i, out)).alias("cells"), F.concat(s["found"], out).alias("found"))
        return F.when(s["stuck"], s).otherwise(_let(single(s["cells"]), lambda out: F.when(F.size(out) == 0, s.withField("stuck", F.lit(True))).otherwise(more(out).withField("stuck", F.lit(False)))))

    none = F.array().cast("array<struct<k:bigint,n:int>>")
    end = F.aggregate(F.sequence(F.lit(1), F.lit(_ROUNDS)), F.struct(cells.alias("cells"), none.alias("found"), F.lit(False).alias("stuck")), step)
    empty = lambda cells: F.forall(cells, lambda x: (x["n"] == 0) & (x["k"] == 0) & (x["c"] == 0))
    return _let(end, lambda s: F.struct(s["found"].alias("found"), empty(s["cells"]).alias("ok")))


def _recovered(a: Column, b: Column) -> Column:
    """The differing digests of two sets of some digests, by sketches of SIZE cells and, as long as peeling fails, of twice as many."""
    none = F.array().cast("array<struct<k:bigint,n:int>>")
    attempt = lambda size: peeled(subtracted(sketch(a, size), sketch(b, size)), size)
    start = F.struct(none.alias("found"), F.lit(False).alias("ok"))
    return F.aggregate(F.sequence(F.lit(0), F.lit(20)), start, lambda s, i: F.when(s["ok"], s).otherwise(_let((F.lit(SIZE) * F.pow(F.lit(2), i)).cast("int"), attempt)))["found"]


def _sharded(keys: Column, high: Column, low: Column) -> Column:
    """high * low arrays of keys, dealt by a remainder, which hardly depends on the bits that place it, in two steps, so that a key is looked at high + low times."""
    bits = lambda k: k % _PRIMES[0]
    first = F.transform(F.sequence(F.lit(0), high - 1), lambda h: F.filter(keys, lambda k: bits(k) % high == h))
    return F.flatten(F.transform(first, lambda some: F.transform(F.sequence(F.lit(0), low - 1), lambda i: F.filter(some, lambda k: F.call_function("div", bits(k), high) % low == i))))


def _larger(a: Column, b: Column, side: Column) -> Column:
    """The differing digests of two sets of any size, by shards, side * side of them."""
    return F.flatten(F.zip_with(_sharded(a, side, side), _sharded(b, side, side), _recovered))


def _side(a: Column, b: Column) -> Column:
    shards = F.greatest((F.size(a) + F.size(b)) / F.lit(_PER_SHARD), F.lit(1.0))
    return F.pow(F.lit(2), F.ceil(F.log2(shards) / 2)).cast("int")


def _cells_of(rows: DataFrame, keys: list[str], pairs: list[tuple[str, str]]) -> DataFrame:
    """(keys, at, n, k, c) of the subtracted sketches of each pair; cells in which nothing is left are no rows.

    at: the pair's number, the binary logarithm of the size and the cell, in one number.
    """
    power = lambda a, b: F.greatest(F.lit(SIZE.bit_length() - 1), F.ceil(F.log2(F.greatest(4 * (F.size(a) + F.size(b)), F.lit(1)))).cast("int"))
    both = lambda a, b, x: F.when(F.col(a).isNotNull() & F.col(b).isNotNull(), F.col(x))
    sides = [F.struct(((F.lit(i) * 64 + power(a, b)).cast("long") * _AT).alias("at"), F.lit(n).alias("n"), both(a, b, x).alias("keys")) for i, (a, b) in enumerate(pairs) for n, x in ((1, a), (-1, b))]
    x = rows.select(*keys, F.explode(F.array(*sides)).alias("x")).select(*keys, "x.at", "x.n", F.explode("x.keys").alias("k"))
    places = F.array(*[F.col("at") + _place(F.col("k"), j, _size(F.col("at"))) + j * _size(F.col("at")) for j in range(3)])
    return _added(x.select(*keys, "n", "k", _check(F.col("k")).alias("c"), F.explode(places).alias("at")), keys)


_AT = 1 << 40


def _size(at: Column) -> Column:
    return F.call_function("shiftleft", F.lit(1).cast("long"), (F.shiftright(at, 40) % 64).cast("int"))


def _added(cells: DataFrame, keys: list[str]) -> DataFrame:
    out = cells.groupBy(*keys, "at").agg(F.sum("n").cast("int").alias("n"), F.bit_xor("k").alias("k"), F.bit_xor("c").alias("c"))
    return out.where("n != 0 or k != 0 or c != 0")


def _turn(cells: DataFrame, keys: list[str], table: int) -> DataFrame:
    """Peels the single digests of one table: a digest leaves its other two cells and stays as a row behind the three tables."""
    size, k, cell = _size(F.col("at")), F.col("k"), F.col("at") % _AT
    row = lambda cell, n: F.struct((F.col("at") - F.col("at") % _AT + cell).alias("at"), n.alias("n"), F.col("k"), F.col("c"))
    single = (cell >= table * size) & (cell < (table + 1) * size) & (F.abs("n") == 1) & (_check(k) == F.col("c"))
    others = [row(_place(k, j, size) + j * size, -F.col("n")) for j in range(3) if j != table]
    moved = F.when(single, F.array(row(cell + 3 * size, F.col("n")), *others)).otherwise(F.array(row(cell, F.col("n"))))
    return _added(cells.select(*keys, F.explode(moved).alias("x")).select(*keys, "x.*"), keys)


def with_differences(rows: DataFrame, keys: list[str], *rounds: dict[str, tuple[str, str]]) -> DataFrame:
    """rows with a column for each pair added: the digests in which two columns of digests differ, as array<struct<k, n>>.

    n is 1 where the first column alone has the digest and -1 where the second has. keys tell rows apart and are not null. If
    rows are partitioned by them, nothing is shuffled. Where either column is null, so is the difference. Pairs of a round are
    peeled together, rounds one after another, which takes less memory.
    """
    out, none = rows, F.array().cast("array<struct<k:bigint,n:int>>")
    for i, pairs in enumerate(rounds):
        cells = _cells_of(rows, keys, list(pairs.values()))
        for turn in range(_TURNS):
            cells = _turn(cells, keys, turn % 3)
        behind, pair = F.col("at") % _AT >= 3 * _size(F.col("at")), F.shiftright("at", 46).cast("int")
        found = cells.groupBy(*keys, pair.alias("pair")).agg(F.collect_list(F.when(behind, F.struct("k", "n"))).alias("found"), F.count_if(~behind).alias("left"))
        found = found.groupBy(*keys).agg(F.map_from_entries(F.collect_list(F.struct("pair", F.struct("found", "left")))).alias(f"__found{i}"))
        out = out.join(found, keys, "left")
        for j, (name, (a, b)) in enumerate(pairs.items()):
            got, null = F.try_element_at(f"__found{i}", F.lit(j)), F.col(a).isNull() | F.col(b).isNull()
            out = out.withColumn("__side", _side(F.col(a), F.col(b)))
            out = out.withColumn(name, F.when(null, F.lit(None)).when(got.isNull(), none).when(got["left"] == 0, got["found"]).otherwise(_larger(F.col(a), F.col(b), F.col("__side"))))
        out = out.drop(f"__found{i}", "__side")
    return out


def likeness(a: Column, difference: Column) -> Column:
    """The share of all digests of two texts that both have, from the first one's digests and the difference; 1 if neither has any."""
    gone = F.size(F.filter(difference, lambda x: x["n"] > 0))
    everything = F.size(a) + F.size(difference) - gone
    return F.when(everything == 0, 1.0).otherwise((F.size(a) - gone) / everything)


def written(keys: Column, cells: Column) -> Column:
    """A fingerprint as text: how many digests, then each cell's count, xor and check."""
    cell = lambda x: F.concat_ws(".", x["n"].cast("string"), F.hex(x["k"]), F.hex(x["c"]))
    return F.concat(F.size(keys).cast("string"), F.lit(":"), F.array_join(F.transform(cells, cell), " "))


def read(fingerprint: Column) -> Column:
    """The cells of a fingerprint as text."""
    number = lambda x: F.conv(x, 16, 10).cast("long")
    cell = lambda x: _let(F.split(x, "\\."), lambda p: _cell(p[0].cast("int"), number(p[1]), number(p[2])))
    return F.transform(F.split(F.split_part(fingerprint, F.lit(":"), F.lit(2)), " "), cell)


def fingerprint(text: Column) -> Column:
    """The fingerprint of a text, null being an empty one: equal texts have equal ones, of some 800 letters whatever the text's length."""
    return _let(digests(text), lambda keys: written(keys, sketch(keys, F.lit(SIZE))))


def _previous(keys: DataFrame) -> DataFrame:
    """keys (k1, k2, doc_id, n, n_chars) with p1, p2 and p_half of the row before, by falling doc_id, then k1 and k2; the first follows the last.

    Rows are sorted by ranges. What crosses from one range into the next is one row each.
    """
    order = [F.col("doc_id").desc_nulls_last(), F.col("k1"), F.col("k2")]
    rows = checkpointed(keys.repartitionByRange(*order).withColumn("range", F.spark_partition_id()))
    w = W.partitionBy("range").orderBy(*order)
    me = F.struct("k1", "k2", F.floor(F.col("n_chars") / 2).cast("int").alias("half"))
    rows = rows.select("*", F.lag(me).over(w).alias("before"), F.lead("k1").over(w).isNull().alias("last"), me.alias("me"))
    ends = rows.where("last").select("range", "me")
    over = W.orderBy("range")
    ends = ends.select(F.col("range"), F.coalesce(F.lag("me").over(over), F.last("me").over(over.rowsBetween(W.unboundedPreceding, W.unboundedFollowing))).alias("end"))
    rows = rows.join(F.broadcast(ends), "range").withColumn("p", F.coalesce("before", "end"))  # a row for each range
    return rows.select("k1", "k2", "doc_id", "n", "n_chars", F.col("p.k1").alias("p1"), F.col("p.k2").alias("p2"), F.col("p.half").alias("p_half"))


def versions(docs: DataFrame) -> DataFrame:
    """(k1, k2, doc_id, n, n_chars, own, next, changed, edited_sha256, again, again_sha256) of each different row of docs (doc_id, text), n of them, with key k1, k2.

    own: its digests, next: those of the next document, changed: those of its edited text, whose last floor(n_chars / 2) code points are
    the first as many of the next document. The next document is the one of the next smaller doc_id; nulls come last, then the largest one
    again; documents of one doc_id are in order of a hash of their texts, so equal rows follow each other: for all but one of them
    the next document is itself, and `again` is what `changed` is then; it is null if n is 1. A null text is an empty one. Texts move once, and at most half
    of each once more.
    """
    text, name = F.coalesce("text", F.lit("")), F.col("doc_id").cast("string")
    hashed = lambda i: F.xxhash64(F.lit(i), name.isNull(), name, text)
    docs = docs.select("doc_id", text.alias("text"), hashed(1).alias("k1"), hashed(2).alias("k2"))
    keys = docs.groupBy("k1", "k2").agg(F.first("doc_id").alias("doc_id"), F.count("*").alias("n"), F.first(F.length("text")).alias("n_chars"))
    one = docs.select("k1", "k2", "text", digests(F.col("text")).alias("own"))
    one = one.withColumn("_n", F.row_number().over(W.partitionBy("k1", "k2").orderBy("k1"))).where("_n = 1").drop("_n")
    own = one.join(_previous(keys), ["k1", "k2"])
    gives = own.select(F.col("p1").alias("k1"), F.col("p2").alias("k2"), F.substring("text", F.lit(1), F.col("p_half")).alias("part"), F.col("own").alias("next"))
    both = own.join(gives, ["k1", "k2"]).withColumn("half", F.floor(F.col("n_chars") / 2).cast("int"))
    head = F.substring("text", F.lit(1), F.col("n_chars") - F.col("half"))
    both = both.withColumn("edited", F.concat(head, F.col("part")))
    both = both.withColumn("edited_again", F.when(F.col("n") > 1, F.concat(head, F.substring("text", F.lit(1), F.col("half")))))
    return both.select(
        "k1", "k2", "doc_id", "n", F.col("n_chars").cast("long").alias("n_chars"), "own", "next", digests(F.col("edited")).alias("changed"), F.sha2("edited", 256).alias("edited_sha256"),
        F.when(F.col("n") > 1, digests(F.col("edited_again"))).alias("again"), F.sha2("edited_again", 256).alias("again_sha256"),
    )


def fingerprinted(docs: DataFrame) -> DataFrame:
    """(doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next) of each row of docs (doc_id, text).

    near: the share of paragraphs, of both texts' different ones, that both have; 1 if neither has any. A null or empty text has
    none. Repeated rows and doc_ids give a row each; other columns are not looked at; an empty table gives none.
    """
    rows = with_differences(versions(docs.select("doc_id", "text")), ["k1", "k2"], {"to_changed": ("own", "changed"), "to_next": ("own", "next"), "to_again": ("own", "again")})
    print_of = lambda c: written(F.col(c), sketch(F.col(c), F.lit(SIZE)))
    near = lambda c: likeness(F.col("own"), F.col(c))
    to = lambda times, sha, f, edited, following: F.struct(times.cast("long").alias("times"), F.col(sha).alias("edited_sha256"), f.alias("edited_fingerprint"), edited.alias("near_edited"), following.alias("near_next"))
    there = to(F.lit(1), "edited_sha256", print_of("changed"), near("to_changed"), near("to_next"))
    same = to(F.col("n") - 1, "again_sha256", print_of("again"), near("to_again"), F.lit(1.0))
    rows = rows.select("doc_id", "n_chars", print_of("own").alias("fingerprint"), F.explode(F.when(F.col("n") > 1, F.array(there, same)).otherwise(F.array(there))).alias("x"))
    rows = rows.select("doc_id", "n_chars", "fingerprint", "x.*")
    rows = rows.withColumn("times", F.explode(F.sequence(F.lit(1).cast("long"), F.col("times"))))
    return rows.select("doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next")
