"""Operators on texts, against plain versions on small tables."""

import math
import random
import re
import zlib
from collections import Counter

import public_tokenizers
import pytest
from tokenizers import Tokenizer

from pageloom.llm import flatfiles, jaccard, langid, lines, lm, mixing, packing
from pageloom.llm.queries import ORACLES, QUERIES

WORD_BPE = public_tokenizers.path("word_bpe_49k.json")
DOCS = "doc_id long, text string, lang string, source string"
SPACE = " \t\n\x0b\f\r"


def tokenizer(special_as_text=True):
    t = Tokenizer.from_file(WORD_BPE)
    t.encode_special_tokens = special_as_text
    return t


def word_list(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def lowered(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


ODD = [
    (1, None, None, None),
    (2, "", "en", "a"),
    (3, " \n\t ", "en", "a"),
    (4, "One line\none LINE \n\nOne line", "en", "b"),
    (4, "One line\none LINE \n\nOne line", "en", "b"),
    (None, "no id\nOne line", "fr", None),
    (6, "Ünïcode é\u0301 😀 <|endoftext|> 's it's " * 3, "de", "a"),
    (7, "long " * 30000 + "\nOne line", "en", "hot"),
    (8, "a\r\nb\r", None, "hot"),
    (9, "one two three", "en", "hot"),
]


@pytest.mark.parametrize("name", list(ORACLES))
def test_query_matches_sql(name, same_rows):
    same_rows(QUERIES[name], ORACLES[name])


# Line dedup


def brute_lines(rows, min_docs):
    key = lambda x: lowered(x.strip(SPACE))
    count = Counter(k for _, t, *_ in rows for k in {key(x) for x in (t or "").split("\n")} if k)
    out = []
    for d, t, *_ in rows:
        all_ = (t or "").split("\n")
        kept = [x for x in all_ if not key(x) or count[key(x)] < min_docs]
        out.append((d, len(all_), len(all_) - len(kept), "\n".join(kept)))
    return sorted(out, key=str)


@pytest.mark.parametrize("batches, fanout", [(1, 2), (2, 2), (5, 2), (6, 3)])
def test_lines(spark, batches, fanout):
    rows = ODD + [(100 + i, f"shared line {i % 4}\n  SHARED line {i % 3}\t\nown {i}", "en", "a") for i in range(30)]
    got = lines.drop_repeated_lines(spark.createDataFrame(rows, DOCS), 3, batches=batches, fanout=fanout)
    assert sorted(((r["doc_id"], r["n_lines"], r["n_dropped"], r["kept_text"]) for r in got.collect()), key=str) == brute_lines(rows, 3)


def test_lines_keep_one(spark):
    rows = [(i, f"same\nown {i}", "en", "a") for i in range(12)]
    got = lines.drop_repeated_lines(spark.createDataFrame(rows, DOCS), 10, keep_first=True).collect()
    assert sum("same" in r["kept_text"] for r in got) == 1


def test_lines_keep_one_of_rows_that_share_an_id(spark):
    rows = [(7 if i % 2 else None, f"same\nown {i}", "en", "a") for i in range(12)] + [(None, "Same ", "en", "b"), (None, "same", "en", "b")]
    got = lines.drop_repeated_lines(spark.createDataFrame(rows, DOCS), 10, keep_first=True, batches=1).collect()
    keeps = [r for r in got if "same" in r["kept_text"].lower()]
    assert len(got) == len(rows) and len(keeps) == 1 and keeps[0]["doc_id"] == 7
    rows = [(None, f"same\nown {i}", "en", "a") for i in range(12)]
    assert sum("same" in r["kept_text"] for r in lines.drop_repeated_lines(spark.createDataFrame(rows, DOCS), 10, keep_first=True).collect()) == 1


def test_lines_of_nothing_and_clashing_columns(spark):
    assert lines.drop_repeated_lines(spark.createDataFrame([], DOCS)).count() == 0
    df = spark.createDataFrame([(1, "a", 5, "k")], "doc_id long, text string, n_lines int, kept_text string")
    assert lines.drop_repeated_lines(df).first()["n_lines"] == 1


def test_runs_hold_what_is_new(spark):
    runs = lines.LineRuns(spark, fanout=2)
    for i in range(4):
        runs.add(spark.createDataFrame([(i, f"x\ny{i}")], "doc_id long, text string"))
    assert set(runs.levels) == {2} or sum(map(len, runs.levels.values())) <= 2
    assert [r["line"] for r in runs.unseen(spark.createDataFrame([(9, "X \nnew\ny2")], "doc_id long, text string")).collect()] == ["new"]


# N-gram Jaccard join


def brute_components(rows, k, percent):
    sets = []
    for _, t, *_ in rows:
        w = word_list(lowered(t))
        sets.append({tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)} if w else set())
    comp = list(range(len(rows)))
    for _ in rows:
        for i, a in enumerate(sets):
            for j, b in enumerate(sets):
                if i < j and a and b and 100 * len(a & b) >= percent * len(a | b):
                    comp[i] = comp[j] = min(comp[i], comp[j])
    least = {}
    for c, r in zip(comp, rows):
        if r[0] is not None:
            least[c] = min(least.get(c, r[0]), r[0])
    return sorted(((r[0], len(s), least.get(c)) for r, s, c in zip(rows, sets, comp)), key=str)


def test_jaccard(spark):
    import random

    rng = random.Random(4)
    vocab = [f"w{i}" for i in range(60)]
    rows = list(ODD)
    for g in range(6):
        base = rng.choices(vocab, k=rng.choice([3, 12, 60, 200]))
        for c in range(7):
            text = list(base)
            for _ in range(rng.choice([0, 0, 1, 2, 5])):
                text[rng.randrange(len(text))] = rng.choice(vocab)
            rows.append((1000 + g * 10 + c, " ".join(text).title() if c % 2 else "\n".join(text), "en", "a"))
    rng.shuffle(rows)
    for k, percent in ((4, 85), (5, 80), (1, 50)):
        got = jaccard.jaccard_components(spark.createDataFrame(rows, DOCS), k, percent).collect()
        assert sorted(((r["doc_id"], r["n_shingles"], r["component_id"]) for r in got), key=str) == brute_components(rows, k, percent)


@pytest.mark.parametrize("hot", [1, 4096])
def test_jaccard_of_a_template_and_of_long_sets(spark, monkeypatch, hot):
    """No column is hot, or all are. Rows that share a template just below the threshold, a large group of near copies beside them, and sets that are cut into several blocks of columns."""
    import random

    monkeypatch.setattr(jaccard, "_HOT", hot)
    rng = random.Random(6)
    template = [f"t{i}" for i in range(100)]
    rows = [(i, " ".join(template + [f"own{i}x{j}" for j in range(rng.choice([9, 12, 13, 20]))]), "en", "a") for i in range(40)]
    rows += [(100 + i, " ".join(template[:50] + [f"new{i}"] + template[50:]), "en", "a") for i in range(40)]
    long = [f"l{i}" for i in range(21000)]
    rows += [(200, " ".join(long), "en", "a"), (201, " ".join(long[:17000]), "en", "a"), (202, " ".join(long[:16700]), "en", "a"), (203, " ".join(long[300:]), "en", "a")]
    got = jaccard.jaccard_components(spark.createDataFrame(rows, DOCS), 5, 80).collect()
    assert sorted(((r["doc_id"], r["n_shingles"], r["component_id"]) for r in got), key=str) == brute_components(rows, 5, 80)


def test_jaccard_keeps_no_large_step(spark, monkeypatch):
    """Entries of columns and blocks of sets are in no checkpoint, which would stay, and what is stored for a while is gone afterwards."""
    from pathlib import Path

    from pageloom.llm import common

    kept = []
    monkeypatch.setattr(jaccard, "checkpointed", lambda df: kept.append(df.columns) or common.checkpointed(df))
    rows = [(i, " ".join(f"w{j}" for j in range(i % 4, 60 + i // 4)), "en", "a") for i in range(24)]
    got = jaccard.jaccard_components(spark.createDataFrame(rows, DOCS), 4, 85).collect()
    assert sorted(((r["doc_id"], r["n_shingles"], r["component_id"]) for r in got), key=str) == brute_components(rows, 4, 85)
    assert kept and not [c for c in kept if {"pos", "members", "x"} & set(c)]
    assert not list(Path(common.shared_dir(spark).removeprefix("file:")).glob("stored-*"))


@pytest.mark.parametrize("at_once", [0, 5, 1 << 20])
def test_connected_components(spark, at_once):
    import random

    from pageloom.llm.common import connected_components

    rng = random.Random(3)
    edges = [(rng.randrange(200), rng.randrange(200)) for _ in range(110)] + [(1000 + i, 1001 + i) for i in range(40)] + [(5000, 5000 + i) for i in range(50)] + [(None, 3), (4, 4)]
    comp = {}
    for _ in range(60):
        for a, b in edges:
            if a is not None and a != b:
                comp[a] = comp[b] = min(comp.get(a, a), comp.get(b, b))
    got = connected_components(spark.createDataFrame(edges, "a long, b long"), "a", "b", at_once=at_once).collect()
    assert {r["node"]: r["component"] for r in got} == comp and len(got) == len(comp)


def test_jaccard_of_nothing(spark):
    assert jaccard.jaccard_components(spark.createDataFrame([], DOCS)).count() == 0
    assert [tuple(r)[:3] for r in jaccard.jaccard_components(spark.createDataFrame([(3, None, None, None)], DOCS)).collect()] == [(3, 0, 3)]


# Mixing


def test_mix_reaches_targets_and_bounds(spark):
    rows = ODD + [(i, "w " * (i % 9), "en", f"s{i % 4}") for i in range(100, 400)] + [(i, "h " * 50, "en", "hot") for i in range(400, 500)]
    got = mixing.taken(spark.createDataFrame(rows, DOCS)).collect()
    again = mixing.taken(spark.createDataFrame(rows[::-1], DOCS)).collect()
    assert sorted(map(tuple, got), key=str) == sorted(map(tuple, again), key=str)
    assert sorted((str(r["doc_id"]), r["size"]) for r in got) == sorted((str(r[0]), len(word_list(r[1]))) for r in rows)
    by = {}
    for r in got:
        assert 0 <= r["taken"] <= 3 * r["size"]
        by.setdefault(r["source"], []).append(r)
    total = sum(r["size"] for r in got)
    assert abs(sum(x[0]["target"] for x in by.values()) - total) < 1e-6 * total
    for x in by.values():
        assert x[0]["target"] <= 3 * x[0]["source_size"] and abs(sum(r["taken"] for r in x) - x[0]["target"]) <= 1


def test_mix_of_nothing_and_clashing_columns(spark):
    assert mixing.taken(spark.createDataFrame([], DOCS)).count() == 0
    df = spark.createDataFrame([(1, "a b", "s", 99, "t"), (1, "a b", "s", 99, "t"), (2, "c", "s", 7, "u"), (3, None, None, 0, None)], "doc_id long, text string, source string, size int, target string")
    assert sorted((r["doc_id"], r["taken"]) for r in mixing.taken(df).collect()) == [(1, 2), (1, 2), (2, 1), (3, 0)]
    assert sorted(map(tuple, mixing.mixed(df).collect())) == [(1, "a b", "s", 99, "t"), (1, "a b", "s", 99, "t"), (2, "c", "s", 7, "u")]


def test_schedule_is_even(spark):
    df = spark.createDataFrame([(i, "w " * 100, "en", "abc"[i % 3]) for i in range(300)], DOCS)
    _, takes = mixing.mix(df, weights=(1, 2, 3), block=64)
    slots = takes.groupBy("slot").agg({"source_no": "min"}).orderBy("slot").collect()
    half = Counter(r[1] for r in slots[: len(slots) // 2])
    share = {k: v / (len(slots) // 2) for k, v in half.items()}
    assert all(abs(share[k + 1] - (k + 1) / 6) < 0.02 for k in range(3))


def test_what_is_taken_comes_from_the_slots(spark):
    """Without the schedule there is neither a slot nor an order."""
    import itertools

    rows = [(i, f"d{i} " + "w\n" * (20 + i % 90), "en", "abc"[i % 3]) for i in range(200)]
    df = spark.createDataFrame(rows, DOCS)
    _, takes = mixing.mix(df, block=64)
    takes = takes.collect()
    assert len({r["slot"] for r in takes}) == len({(r["slot"], r["source_no"]) for r in takes})  # a slot is one source's
    own = {r["doc_id"]: r for r in mixing.taken(df, block=64).collect()}
    assert sum(r["slots"] for r in own.values()) == len(takes) and sum(r["taken"] for r in own.values()) == sum(r["words_to"] - r["words_from"] for r in takes)
    assert min(r["first_slot"] for r in own.values() if r["taken"]) == min(r["slot"] for r in takes)
    assert all((r["first_slot"] is None) == (r["taken"] == 0) for r in own.values())
    parts = mixing.mixed(df, partition_words=1 << 11, block=64).rdd.glom().collect()
    assert len(parts) > 3
    seen = set()
    slots = [own[r["doc_id"]]["first_slot"] for r in itertools.chain(*parts) if not (r["doc_id"] in seen or seen.add(r["doc_id"]))]
    assert slots == sorted(slots)
    half = Counter(r["source"] for r in itertools.chain(*parts[: len(parts) // 2]) for _ in word_list(r["text"]))
    total = sum(half.values())
    assert all(abs(half[s] / total - k / 6) < 0.1 for k, s in enumerate("abc", 1))


def test_a_cut_document_keeps_its_lines(spark):
    text = "\n\tone  two\r\nthree\n\nfour five "
    df = spark.createDataFrame([(1, text, "en", "s"), (2, "x", "en", "t")], DOCS).withColumn("k", langid.F.explode(langid.F.sequence(langid.F.lit(0), langid.F.lit(6))))
    got = {r[0]: r[1] for r in df.where("doc_id = 1").select("k", mixing.first_words(langid.F.col("text"), langid.F.col("k"))).collect()}
    assert got == {0: "", 1: "\n\tone", 2: "\n\tone  two", 3: "\n\tone  two\r\nthree", 4: "\n\tone  two\r\nthree\n\nfour", 5: "\n\tone  two\r\nthree\n\nfour five", 6: text}


# Packing


def check_packing(rows, got, capacity):
    ids = {d: x.ids + [0] for (d, *_), x in zip(rows, tokenizer(False).encode_batch([r[1] or "" for r in rows], add_special_tokens=False))}
    pieces, seqs = {}, {}
    for r in got:
        pieces.setdefault(r["doc_id"], []).append(r)
        seqs.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    assert set(pieces) == set(ids)
    for d, x in pieces.items():
        x.sort(key=lambda r: r["piece"])
        assert [r["piece"] for r in x] == list(range(-(-len(ids[d]) // capacity)))
        for r in x:
            part = ids[d][r["piece"] * capacity :][:capacity]
            assert (r["start"], r["length"]) == (r["piece"] * capacity, len(part))
            assert r["ids_crc32"] == zlib.crc32(b"".join(i.to_bytes(4, "little") for i in part))
    for x in seqs.values():
        at = 0
        for offset, length in sorted(x):
            assert offset == at
            at += length
        assert at <= capacity
    return len(seqs), -(-sum(map(len, ids.values())) // capacity)


def test_packing_query(spark, sf_dir):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()]
    used, bound = check_packing(rows, QUERIES["op3_best_fit_packing"](spark, sf_dir).collect(), 2048)
    assert used <= bound * 1.01 + 1


def test_packing_odd_rows(spark):
    rows = [r for r in ODD if r[0] is not None and r[0] != 4]
    check_packing(rows, packing.pack_documents(spark.createDataFrame(rows, DOCS), WORD_BPE, 64).collect(), 64)
    assert packing.pack_documents(spark.createDataFrame(ODD, DOCS), WORD_BPE, 64).where("doc_id = 4 and piece = 0").count() == 2
    assert packing.pack_documents(spark.createDataFrame([], DOCS), WORD_BPE).count() == 0


# Language ID


def brute_bits(text, training, order=langid.ORDER):
    """Bits of every stretch of a text in every language, by contexts in dictionaries."""
    counts = {}
    for lang, some in training.items():
        own = counts[lang] = {}
        for t in some:
            s = b" " * order + t.encode()
            for i in range(order, len(s)):
                for k in range(order + 1):
                    own.setdefault(s[i - k : i], Counter())[s[i]] += 1

    def p(own, c, b):
        n = own.get(c, Counter())
        lower = p(own, c[1:], b) if c else 1 / 256
        m, kinds = sum(n.values()), len(n)
        return lower if not m else n[b] / (m + kinds) + kinds / (m + kinds) * lower

    data = b" " * order + text.encode()
    plain = {b"": sum((own[b""] for own in counts.values()), Counter())}
    out = []
    for a in range(order, len(data), langid.WINDOW):
        stop = min(a + langid.WINDOW, len(data))
        bits = {x: -sum(math.log2(p(counts[x], data[i - order : i], data[i])) for i in range(a, stop)) for x in training}
        out.append((stop - a, bits, -sum(math.log2(p(plain, b"", data[i])) for i in range(a, stop))))
    return out


def brute_language(text, training):
    share, gain = Counter(), 0.0
    for size, bits, plain in brute_bits(text, training):
        least = min(bits.values())
        odds = {x: 2 ** (least - b) for x, b in bits.items()}
        gain += plain - least + math.log2(sum(odds.values()) / len(odds))
        for x in odds:
            share[x] += size * odds[x] / sum(odds.values())
    best = max(sorted(training), key=lambda x: share[x])
    return best, share[best] / sum(share.values()), gain


def test_language_model_against_dictionaries(spark):
    training = {"aa": ["the cat sat on the mat", "that is the hat"], "bb": ["der hund und die katze", "das ist der hut"]}
    rows = [(10 * k + i, t, x, None) for k, (x, some) in enumerate(training.items()) for i, t in enumerate(some)]
    model = langid.train(spark.createDataFrame(rows, DOCS))
    texts = ["the hut", "und that", "zzz é", "a", "die katze sat " * 40, "123 x"]
    got = langid.predict(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), model).orderBy("doc_id").collect()
    for r, t in zip(got, texts):
        lang, score, gain = brute_language(t, training)
        assert r["lang_pred"] == lang and math.isclose(r["score"], score, rel_tol=1e-4) and math.isclose(r["gain"], gain, rel_tol=1e-4, abs_tol=1e-3)


def test_languages_learn_from_whole_texts_counted_in_pieces(spark, monkeypatch):
    monkeypatch.setattr(langid, "_COUNTED", 100)
    monkeypatch.setattr(langid, "_PIECE", 64)
    training = {"aa": ["the cat " * 30 + "quizzical"], "bb": ["der hund " * 30, "zebra"]}
    rows = [(10 * k + i, t, x, None) for k, (x, some) in enumerate(training.items()) for i, t in enumerate(some)]
    docs = spark.createDataFrame(rows + rows, DOCS)
    counts = [r.asDict() for b in [spark.createDataFrame([(int(x == "bb"), t) for x, some in training.items() for t in some], "language int, text string")] for r in b.mapInArrow(langid._counted, "language int, code long, n long").collect()]
    assert sum(c["n"] for c in counts) == sum(len(t) for some in training.values() for t in some)
    for r in langid.predict(spark.createDataFrame([(1, "a quizzical zebra " * 20)], "doc_id long, text string"), langid.train(docs)).collect():
        lang, score, gain = brute_language(r["text"], training)
        assert r["lang_pred"] == lang and math.isclose(r["score"], score, rel_tol=1e-4) and math.isclose(r["gain"], gain, rel_tol=1e-4)


def test_two_hundred_languages(spark):
    """Their trees are as large as what each saw: no table of all codes by all languages, no limit on labels."""
    rnd = random.Random(5)
    words = {f"l{i:03}": ["".join(rnd.choices("abcdefghijklmnop", k=rnd.randint(3, 8))) for _ in range(30)] for i in range(200)}
    rows = [(10 * i + k, " ".join(rnd.choices(words[x], k=120)), x, None) for i, x in enumerate(words) for k in range(4)]
    model = langid.train(spark.createDataFrame(rows, DOCS))
    assert len(model.languages) == 200 and len(model.seen[-1].bits) < len(model.seen[-1].code) * 20
    fresh = [(i, " ".join(rnd.choices(words[x], k=60)), x) for i, x in enumerate(words)]
    got = langid.predict(spark.createDataFrame(fresh, "doc_id long, text string, lang string"), model).collect()
    assert len(got) == 200 and all(r["lang_pred"] == r["lang"] and r["gain"] > 0 for r in got)


def test_language_id_odd_rows(spark):
    model = langid.train(langid.training_rows(spark.createDataFrame(ODD, DOCS)))
    got = {r["doc_id"]: r for r in langid.predict(spark.createDataFrame(ODD, DOCS).withColumn("score2", langid.F.lit(1)), model).collect()}
    assert [got[k]["lang_pred"] for k in (1, 2, 3)] == ["und"] * 3 and got[1]["score"] == 0
    assert got[9]["lang_pred"] in ("en", "de", "fr") and 0 < got[9]["score"] <= 1
    empty = langid.train(spark.createDataFrame([], DOCS))
    assert {r["lang_pred"] for r in langid.predict(spark.createDataFrame(ODD, DOCS), empty).collect()} == {"und"}


def test_language_id_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.01"
    truth = {r[0]: r[1] for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "lang").collect()}
    held = [r for r in QUERIES["op8_language_id"](spark, sf).collect() if r["held_out"]]
    assert {r["doc_id"] for r in held} == {d for d in truth if zlib.crc32(str(d).encode()) % 3 == 1}
    assert sum(r["lang_pred"] == truth[r["doc_id"]] for r in held) / len(held) > 0.98


# LM scoring


def brute_scores(rows, alpha=0.4):
    """Each document under the counts of all others, by trigrams, bigrams and tokens."""
    ids = {(d, t): x.ids for (d, t, *_), x in zip(rows, tokenizer().encode_batch([r[1] or "" for r in rows], add_special_tokens=False))}
    grams = {k: [Counter(zip([-1, -1, *x], [-1, *x], x)), Counter(zip([-1, *x], x)), Counter(x)] for k, x in ids.items()}
    all_of = [Counter(), Counter(), Counter()]
    for d, t, *_ in rows:
        for total, own in zip(all_of, grams[d, t]):
            total.update(own)
    followed = [Counter(), Counter()]
    for total, order in zip(all_of, followed):
        for g, n in total.items():
            order[g[:-1]] += n
    tokens = sum(all_of[2].values())
    out = {}
    for key, x in ids.items():
        own = grams[key]
        own_followed = [Counter(), Counter()]
        for total, order in zip(own, own_followed):
            for g, n in total.items():
                order[g[:-1]] += n
        s = 0.0
        for (a, b, c), m in own[0].items():
            three, two = all_of[0][a, b, c] - m, all_of[1][b, c] - own[1][b, c]
            if three > 0:
                p = three / (followed[0][a, b] - own_followed[0][a, b])
            elif two > 0:
                p = alpha * two / (followed[1][b,] - own_followed[1][b,])
            else:
                p = alpha * alpha * max(all_of[2][c] - own[2][c], 0.5) / max(tokens - len(x), 1)
            s += m * math.log2(p)
        out[key] = (len(x), s)
    return out


def test_stupid_backoff(spark):
    rows = ODD + [(50 + i, f"one line of {i} words and one line more", "en", "a") for i in range(20)]
    want = brute_scores(rows)
    got = lm.stupid_backoff(spark.createDataFrame(rows, DOCS), WORD_BPE).collect()
    by_id = {d: v for (d, _), v in want.items()}
    assert len(got) == len(rows)
    for r in got:
        n, s = by_id[r["doc_id"]]
        assert r["n_tokens"] == n and abs(r["log2_sum"] - s) < 1e-4 * max(1, n)
        assert (r["score"] is None) == (n == 0)


@pytest.mark.parametrize("part", [1, 7, 1000])
def test_stupid_backoff_with_salts(spark, part):
    """One input partition, and more salts than documents that meet in most of the hash partitions."""
    rows = [r for r in ODD if r[0] != 7] + [(50 + i, f"one line of {i} words and one line more", "en", "a") for i in range(20)]
    by_id = {d: v for (d, _), v in brute_scores(rows).items()}
    for r in lm.stupid_backoff(spark.createDataFrame(rows, DOCS).coalesce(1), WORD_BPE, part=part).collect():
        n, s = by_id[r["doc_id"]]
        assert r["n_tokens"] == n and abs(r["log2_sum"] - s) < 1e-4 * max(1, n)


def test_documents_that_occur_twice_score_apart(spark):
    import random

    rng = random.Random(1)
    vocab = ["".join(rng.choices("abcdefgh", k=4)) for _ in range(3000)]
    texts = [" ".join(rng.choices(vocab, k=rng.randint(30, 200))) for _ in range(120)]
    rows = [(i, t, "en", "a") for i, t in enumerate(texts + texts[:6])]
    got = {r["doc_id"]: r["score"] for r in lm.stupid_backoff(spark.createDataFrame(rows, DOCS), WORD_BPE).collect()}
    assert min(got[i] for i in [*range(6), *range(120, 126)]) > max(got[i] for i in range(6, 120))
    plain = {r["doc_id"]: r["score"] for r in lm.stupid_backoff(spark.createDataFrame(rows, DOCS), WORD_BPE, leave_out=False).collect()}
    assert all(plain[i] >= got[i] for i in got)


def test_stupid_backoff_of_nothing(spark):
    assert lm.stupid_backoff(spark.createDataFrame([], DOCS), WORD_BPE).count() == 0
    assert tuple(lm.stupid_backoff(spark.createDataFrame([(1, None, None, None)], DOCS), WORD_BPE).first()) == (1, 0, None, 0.0)


def test_stupid_backoff_query(spark, sf_dir):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()]
    by_id = {d: v for (d, _), v in brute_scores(rows).items()}
    got = QUERIES["op7_lm_scoring"](spark, sf_dir).collect()
    assert all(r["n_tokens"] == by_id[r["doc_id"]][0] and abs(r["log2_sum"] - by_id[r["doc_id"]][1]) < 1e-4 * max(1, r["n_tokens"]) for r in got) and len(got) == len(rows)


# Token counts


@pytest.mark.parametrize("block", [4, 64, 4 << 20])
def test_flat_files(spark, tmp_path, block):
    rows = flatfiles.write_flat(spark.createDataFrame(ODD, DOCS).repartition(3), f"file://{tmp_path}/flat", WORD_BPE, 49407)
    found = flatfiles.scan_flat(rows.select("file"), 49407, block_bytes=block)
    got = rows.join(found, ["file", "ordinal"]).select("doc_id", "n_tokens", "ended").collect()
    want = [(d, len(x.ids)) for (d, *_), x in zip(ODD, tokenizer().encode_batch([r[1] or "" for r in ODD], add_special_tokens=False))]
    assert sorted(((r["doc_id"], r["n_tokens"]) for r in got), key=str) == sorted(want, key=str) and all(r["ended"] for r in got)


def test_scan_of_foreign_files(spark, tmp_path):
    import numpy as np

    data = {"a": [1, 2, 9, 9, 3, 9], "b": [9, 4, 5, 6], "c": [], "d": [7]}
    for k, x in data.items():
        (tmp_path / k).write_bytes(np.array(x, "<u2").tobytes() + (b"\x01" if k == "d" else b""))
    files = spark.createDataFrame([(f"file:{tmp_path}/{k}",) for k in data], "file string")
    for block in (2, 6, 100):
        got = sorted((r["file"][-1], r["ordinal"], r["start"], r["n_tokens"], r["ended"]) for r in flatfiles.scan_flat(files, 9, block_bytes=block).collect())
        assert got == [("a", 0, 0, 2, True), ("a", 1, 3, 0, True), ("a", 2, 4, 1, True), ("b", 0, 0, 0, True), ("b", 1, 1, 3, False), ("d", 0, 0, 1, False)]


def test_token_counts_query(spark, sf_dir):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()]
    want = {d: len(x.ids) for (d, _), x in zip(rows, tokenizer().encode_batch([r[1] or "" for r in rows], add_special_tokens=False))}
    assert {r["doc_id"]: r["n_tokens"] for r in QUERIES["op10_token_counts"](spark, sf_dir).collect()} == want


@pytest.mark.parametrize("name", ["_letter", "_letter_", "_k", "_r", "_hit", "_HEAVY", "_kept", "_row", "h", "h1", "salt", "first", "shard", "row", "items", "x", "island", "offset"])
def test_columns_of_internal_names_stay(spark, name):
    docs = spark.createDataFrame([(i, f"the text {i}\nand a line", "en", "mine") for i in range(12)], f"doc_id long, text string, lang string, `{name}` string")
    model = langid.train(docs)
    said = langid.predict(docs, model).collect()
    dropped = lines.drop_repeated_lines(docs, min_docs=10).collect()
    assert {r[name] for r in said} == {r[name] for r in dropped} == {"mine"} and {r.n_dropped for r in dropped} == {1}
    pieces = spark.createDataFrame([(i, 3 + i, "mine") for i in range(12)], f"doc_id long, length int, `{name}` string")
    placed = packing.pack_pieces(pieces, capacity=10).collect()
    assert sorted(r.doc_id for r in placed if r.length < 10 or r.offset == 0) == [*range(12)] and (name == "offset" or {r[name] for r in placed} == {"mine"})
