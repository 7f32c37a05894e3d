import hashlib
import random
import re
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F
from test_documents import SPACE, brute_components, brute_language, lowered, tokenizer, word_list

import corpus_pipeline

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"


def corpus():
    rng = random.Random(8)
    words = {"en": [a + b for a in ("th", "wh", "str", "ing") for b in ("e", "at", "ick", "ough")], "de": [a + b for a in ("sch", "ü", "zw", "pf") for b in ("ein", "ung", "acht", "ö")]}
    rows = []
    for i in range(70):
        lang = rng.choice(["en", "de"])
        body = [" ".join(rng.choices(words[lang], k=rng.randint(3, 30))) for _ in range(rng.randint(1, 5))]
        if rng.random() < 0.4:
            body.insert(rng.randint(0, len(body)), rng.choice(["Subscribe now", " SUBSCRIBE NOW", "all rights reserved"]))
        rows.append([i, "\n".join(body), lang if rng.random() < 0.9 else None, rng.choice(["a", "b", "hot", "hot", "hot", None])])
    for i in range(70, 90):
        text = rows[rng.randrange(70)][1]
        rows.append([i, text.replace("the", "tha", 1) if i % 2 else text, "en", "b"])
    rows += [[90, None, "en", "a"], [91, "", "en", "a"], [92, "12 34", "en", "a"], [94, "thick", "en", "a"], [95, "Zwung", "de", "b"], [93, "Subscribe now\nsubscribe NOW", "en", "a"]]
    return [(*r, len(r[1]) if r[1] is not None else None) for r in rows]


def brute_until_mixed(rows, batch):
    """Texts of every row that reaches packing, as a sorted list of (doc_id, text)."""
    training = {}
    for d, t, lang, *_ in rows:
        if lang and t and zlib.crc32(str(d).encode()) % 3 != 1:
            training.setdefault(lang, []).append(t)
    kept = []
    for r in rows:
        if any(c.isalpha() for c in r[1] or ""):
            if brute_language(r[1], training)[2] > -64:
                kept.append(r)
    # lines
    key = lambda x: lowered(x.strip(SPACE))
    holders = {}
    for d, t, *_ in kept:
        for k in {key(x) for x in t.split("\n")} - {""}:
            holders.setdefault(k, []).append(d)
    first = {}
    for k, ds in holders.items():
        if len(ds) >= 10:
            early, middle = ([d for d in ds if batch[d] < n] for n in (1, 2))
            first[k] = min(early if len(early) >= 10 else middle if len(middle) >= 10 else ds)
    docs = []
    for d, t, lang, source, _ in kept:
        lines = t.split("\n")
        left = [x for x in lines if key(x) not in first or first[key(x)] == d]
        if len(left) == len(lines) or word_list("\n".join(left)):
            docs.append((d, "\n".join(left), source))
    # near copies
    comp = {d: c for d, _, c in brute_components([(d, t) for d, t, _ in docs], 5, 80)}
    docs = [x for x in docs if comp[x[0]] == x[0]]
    # the mix
    names = sorted({s for _, _, s in docs}, key=lambda s: (s is None, s or ""))
    weight = {s: i % 3 + 1 for i, s in enumerate(names)}
    size = {s: sum(len(word_list(t)) for _, t, x in docs if x == s) for s in names}
    target, free, rest = {}, set(names), float(sum(size.values()))
    while free:
        level = rest / sum(weight[s] for s in free)
        over = {s for s in free if 3 * size[s] < weight[s] * level}
        for s in over or free:
            target[s] = 3.0 * size[s] if over else weight[s] * level
            rest -= target[s] if over else 0
        free = free - over if over else set()
    out = []
    for s in names:
        quota = int(target[s] + 0.5)
        own = sorted(((hashlib.md5(f"mix:{d}".encode()).hexdigest(), d, t) for d, t, x in docs if x == s))
        while quota > 0:
            for _, d, t in own:
                w = word_list(t)
                if quota > 0 and w:
                    out.append((d, t if quota >= len(w) else re.match(rf"(?:[{SPACE}]*[^{SPACE}]+){{{quota}}}", t)[0]))
                    quota -= len(w)
    return sorted(out)


@pytest.fixture(scope="module")
def ran(spark, tmp_path_factory):
    sf = str(tmp_path_factory.mktemp("sf"))
    rows = corpus()
    spark.createDataFrame(rows, COLUMNS).write.parquet(f"{sf}/documents.parquet")
    batch = {r[0]: r[1] for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", F.pmod(F.xxhash64(F.lit(11), "doc_id"), F.lit(3))).collect()}
    docs, texts = spark.read.parquet(f"{sf}/documents.parquet"), []
    for i, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, sf).write.parquet(f"{sf}/stage{i}")
        docs = spark.read.parquet(f"{sf}/stage{i}")
        texts.append(docs)
    return rows, batch, texts, corpus_pipeline.run(spark, sf)


def test_stages_keep_the_columns_of_documents(ran):
    rows, _, stages, _ = ran
    assert [s.columns for s in stages[:-1]] == [["doc_id", "text", "lang", "source", "n_chars"]] * 4
    assert all(r["n_chars"] == len(r["text"]) for s in stages[1:-1] for r in s.collect())


def test_against_brute_force(ran):
    rows, batch, stages, final = ran
    want = brute_until_mixed(rows, batch)
    assert sorted((r["doc_id"], r["text"]) for r in stages[3].collect()) == want
    got = final.collect()
    ids = [(d, x.ids + [0]) for (d, _), x in zip(want, tokenizer(False).encode_batch([t for _, t in want], add_special_tokens=False))]
    pieces = Counter((d, k // 2048, k, len(x[k : k + 2048]), zlib.crc32(b"".join(i.to_bytes(4, "little") for i in x[k : k + 2048]))) for d, x in ids for k in range(0, len(x), 2048))
    assert Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in got) == pieces
    seqs = {}
    for r in got:
        seqs.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for x in seqs.values():
        ends = [0]
        for offset, length in sorted(x):
            assert offset == ends[-1]
            ends.append(offset + length)
        assert ends[-1] <= 2048
    assert len(seqs) <= -(-sum(len(x) for _, x in ids) // 2048) + 1


def test_language_stage_rejects_by_evidence(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text", "lang", "source", "n_chars")
    parts = [r[0] for r in docs.where("length(text) > 400").groupBy("lang").agg(F.min_by(F.substring("text", 1, 400), "doc_id")).orderBy("lang").select(F.col("min_by(substring(text, 1, 400), doc_id)")).collect()]
    own = [(-1, "\n".join(parts[:3])), (-2, "Ok"), (-3, parts[0][:20]), (-4, "aGVsbG8gd29ybGQKcXdlcnR5dWlvcGFzZGZnaGprbHp4Y3Zibm0xMjM0NTY3ODkw" * 3), (-5, "123 456"), (-6, None)]
    own = spark.createDataFrame([(*r, None, "a", 1) for r in own], COLUMNS)
    kept = {r["doc_id"] for r in corpus_pipeline.identify_language(spark, docs.union(own), "").collect()}
    assert {x for x in kept if x < 0} == {-1, -2, -3} and {r["doc_id"] for r in docs.collect()} <= kept


@pytest.mark.parametrize("name", ["_one", "_row", "_n", "key", "component", "is_first", "row", "gain", "Score", "lang_pred", "kept_text", "n_dropped", "_letter"])
def test_columns_of_internal_names_pass_the_stages(spark, name):
    words = " ".join(f"word{i}" for i in range(30))
    rows = [(i, f"the text {i} of many and {words}\na line", "en", "s", 1, f"mine {i}") for i in range(12)]
    docs = spark.createDataFrame(rows, f"{COLUMNS}, `{name}` string")
    for _, stage in corpus_pipeline.STAGES[:4]:
        docs = spark.createDataFrame(stage(spark, docs, "").collect(), docs.schema)
        assert all(r[name] == f"mine {r['doc_id']}" for r in docs.collect()) and docs.count() > 0


def test_near_copies_by_row(spark):
    words = [f"w{i}" for i in range(40)]
    x, y, z, v = " ".join(words), " ".join(words[::-1]), " ".join(words[::2]), " ".join(words[1::2])
    rows = [
        (1, x, "en", "a"), (1, x, "en", "a"), (1, x, "en", "b"), (2, x + " more", "en", "a"),  # one row of id 1 stays
        (1, y, "en", "a"), (3, y, "en", "a"),  # id 1 again, in another group
        (5, z, "en", "a"), (4, z, "en", "a"), (5, "five words that nobody else has", "en", "a"),  # 5 is first elsewhere only
        (None, v, "en", "a"), (None, v, None, "a"), (None, v, "a", None), (None, "all of it by itself here", "en", "a"), (9, v, "en", "a"),  # 9 stays, of v
        (None, "", "en", "a"), (None, "", "en", "a"),  # linked with nothing
    ]
    docs = spark.createDataFrame([(*r, len(r[1])) for r in rows], COLUMNS)
    got = corpus_pipeline.drop_near_copies(spark, docs, "")
    assert got.columns == docs.columns
    want = [(1, x), (1, y), (4, z), (5, rows[8][1]), (9, v), (None, rows[12][1]), (None, ""), (None, "")]
    assert sorted(((r["doc_id"], r["text"]) for r in got.collect()), key=str) == sorted(want, key=str)


def test_empty_documents(spark, tmp_path):
    spark.createDataFrame([], COLUMNS).write.parquet(f"{tmp_path}/documents.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_rest_imports_without_the_subpackage():
    """Only __spark_entry__ knows that the operators may be absent."""
    import subprocess
    import sys

    code = "import sys; sys.modules['pageloom.llm'] = None\ntry:\n import corpus_pipeline\nexcept ModuleNotFoundError: pass\nimport pageloom.queries as q; print(len(q.QUERIES))"
    assert int(subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, check=True).stdout) > 60
