"""Operators of the corpus pipeline against brute force, round trips and edge cases."""

import collections
import json
import math
import zlib

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from pqledger.llm import decontaminate, html, language, linkage, lm, mixing, neardup, quality, substring, tokens, toxicity

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, extra string, score string, id string, class_id string"
EDGES = [(1, None), (2, ""), (3, "a"), (3, "a"), (None, "b c d"), (5, "word " * 3000), (6, " \n\t "), (7, "x\ny\nx\nx")]


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "e", "s", "i", "c") for i, t in rows], DOCS)


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


def texts_of(docs):
    return {r.doc_id: r.text for r in docs.collect()}


def words(i, n, seed=0):
    rng = np.random.default_rng(seed * 1000 + i)
    return [f"w{x}" for x in rng.integers(0, 5000, n)]


def test_quality_sql(spark):
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{SF}/documents.parquet'")
    want = con.execute(quality.ORACLE["op1_quality_rules"]).df().sort_values("doc_id").reset_index(drop=True)
    got = quality.op1_quality_rules(spark, SF).toPandas()[list(want.columns)].sort_values("doc_id").reset_index(drop=True)
    assert got.equals(want)


def test_quality_edges(spark):
    got = {(r.doc_id, r.n_words): r for r in quality.quality_rules(frame(spark, EDGES)).collect()}
    assert len(got) == 7 and got[1, 0].base_failed and not got[2, 0].kept
    assert got[5, 3000].n_repeat_words == 3000 and got[7, 4].n_dup_lines == 2
    many = " ".join(f"a{i % 40} b{i % 40} c{i % 40}" for i in range(100))  # more repeated windows than are looked up one by one
    assert quality.quality_rules(frame(spark, [(1, many)])).first().n_repeat_words == 300
    assert quality.quality_rules(frame(spark, [])).count() == 0


def test_tokens_round_trip(spark, docs, tmp_path):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(tokens.default_tokenizer())
    odd = [(900001, "Ångström ΣΑΣ don't 12,3"), (900002, "<|endoftext|> a"), (900003, "é a\x1cc\x85d İx ß ẞ 日本 😀"), *[(None if i is None else 900100 + i, x) for i, x in EDGES]]
    df = docs.select("doc_id", "text").unionByName(frame(spark, odd).select("doc_id", "text"))
    manifest = tokens.write_tokens(df, str(tmp_path / "t"), shards=3)
    got = tokens.read_tokens(spark, str(tmp_path / "t"), manifest).orderBy("start").collect()
    want = sorted(((r.doc_id, r.text) for r in df.collect()), key=lambda x: (x[0] is not None, x[0] or 0, x[1] or ""))
    start = 0
    for (key, text), r in zip(want, got, strict=True):
        ids = np.array([*t.encode(text or "", add_special_tokens=False).ids, 2], "<u4")
        assert (r.doc_id, r.start, r.n_tokens, r.ids_crc32, bytes(r.ids)) == (key, start, len(ids), zlib.crc32(ids.tobytes()), ids.tobytes())
        start += len(ids)
    assert json.loads(next((tmp_path / "t").glob("manifest-*")).read_text())[-1]["tokens"] == manifest[-1]["tokens"]
    assert tokens.token_digest(frame(spark, [])).count() == 0


def test_decontamination(spark):
    item = " ".join(words(1, 20)) + " Alice bought 12 kg of apples for 30 dollars and Alice paid."
    other = item.replace("Alice", "Bobby").replace("12", "77").replace("30", "8")
    broken = item.replace("Alice bought", "Bobby bought")  # one slot value, two names
    alone = " ".join(words(2, 60))
    rows = [(1, f"before it {item} after"), (2, other), (3, alone), (4, None), (5, ""), (6, " ".join(words(1, 20)[:9]) + " " + alone), (None, item), (7, item), (7, item)]
    bench = spark.createDataFrame([(10, item), (11, None), (12, "too short"), (10, item)], "item_id long, text string")
    got = {(r.doc_id, r.item_id) for r in decontaminate.contaminated(frame(spark, rows), bench).collect()}
    assert got == {(1, 10), (2, 10), (7, 10)}
    names = "He saw Alice give 5 coins to Alice near old stone bridge while Alice slept under green trees"
    mixed_up = names.replace("Alice", "Bob", 1)
    b = spark.createDataFrame([(1, names)], "item_id long, text string")
    assert [r.doc_id for r in decontaminate.contaminated(frame(spark, [(1, names), (2, mixed_up), (3, names.replace("Alice", "Bob"))]), b).orderBy("doc_id").collect()] == [1, 3]
    assert broken and decontaminate.contaminated(frame(spark, []), b).count() == 0


def test_items_of_few_words_match_whole_texts(spark):
    bench = spark.createDataFrame([(1, "who is he"), (2, "Paris"), (3, "")], "item_id long, text string")
    rows = [(1, "Who is he?"), (2, "and who is he then"), (3, "paris"), (4, "Paris Paris"), (5, ""), (6, None), (7, "who is")]
    got = {(r.doc_id, r.item_id) for r in decontaminate.contaminated(frame(spark, rows), bench).collect()}
    assert got == {(1, 1), (3, 2)}


def test_decontamination_same_without_broadcast(spark, docs, monkeypatch):
    bench = spark.read.parquet(f"{SF}/benchmark.parquet")
    want = sorted(map(tuple, decontaminate.contaminated(docs, bench).collect()))
    monkeypatch.setattr(decontaminate, "BROADCAST_ROWS", 0)
    monkeypatch.setattr(decontaminate, "BROADCAST_WINDOWS", 0)
    assert want and sorted(map(tuple, decontaminate.contaminated(docs, bench).collect())) == want


def test_decontamination_on_documents(spark, docs):
    bench = spark.read.parquet(f"{SF}/benchmark.parquet")
    items = [(r.item_id, r.text) for r in bench.collect()]
    want = {(d, i) for d, t in texts_of(docs).items() for i, b in items if b in t}
    got = {(r.doc_id, r.item_id) for r in decontaminate.contaminated(docs, bench).collect()}
    assert want <= got


def test_html():
    model = html.default_model()
    page = "<html><head><title>T</title></head><body><nav><ul><li><a href=x>Home</a></li></ul></nav><div class='cookie-notice'>We use cookies.</div><article><h1>Title &amp; more</h1><p>First <b>bold\n text.</b><p>Second one, with  spaces.<br></article><section class=comments><h3>Comments</h3><p>I disagree with all of this, sir.</p></section><footer>&copy; site</footer></body></html>"
    assert html.main_text(model, page) == "Title & more\nFirst bold text.\nSecond one, with spaces."
    right = total = 0
    for p, marks in html.labelled_pages(40, seed=77):
        y = model.decode(html.features(html.blocks_of(p)))
        right += sum(int(a) == int(b) for a, b in zip(y, marks, strict=True))
        total += len(y)
    assert right / total > 0.97
    assert html.main_text(model, "") == "" and html.main_text(model, "<p") == "" and html.main_text(model, "<script>x</scr") == ""


def test_html_edges(spark):
    df = spark.createDataFrame([(1, "u", None, "x"), (1, "u", "", "x"), (None, None, "<article><h1>One thing.</h1><p>Some &am", "x")], "page_id long, url string, html string, text string")
    got = html.extract(df, html.default_model()).collect()
    assert len(got) == 3 and got[0].text == "" and got[2].text.startswith("One thing.")


def test_mixing_matches_brute_force(spark, docs):
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    got = mixing.mixed(docs, mixing.labelled_by_lang(docs, labels), mixing.TARGETS).collect()
    n, p, r = np.array([x.n_tokens for x in got]), np.array([x.p for x in got]), np.array([x.rate for x in got])
    assert len(got) == docs.count() and (r >= 0).all() and np.allclose(p.sum(1), 1)
    names = sorted({x.lang for x in docs.collect()})
    want = np.array([mixing.TARGETS[x] for x in names])
    assert np.abs((n * r) @ p / n.sum() - want / want.sum()).max() < 0.02
    truth = {x.doc_id: x.lang for x in docs.collect()}
    assert np.mean([names[int(np.argmax(x.p))] == truth[x.doc_id] for x in got]) > 0.9
    w = n / n.sum()  # the same steps, in numpy
    h, t, rr = (p * w[:, None]).T @ p + 1e-9 * np.eye(len(names)), want / want.sum(), np.ones(len(n))
    for _ in range(mixing.STEPS):
        s = (w * rr) @ p
        g = np.linalg.solve(h, s - t)
        rr = np.maximum(0, rr - (p @ g + mixing.RIDGE * (rr - 1)) / (1 + mixing.RIDGE))
        if np.abs(s - t).max() < 1e-4:
            break
    assert np.abs(rr - r).max() < 1e-6


def test_mixing_edges(spark):
    none = spark.createDataFrame([], "doc_id long, domain string")
    assert {r.rate for r in mixing.mixed(frame(spark, EDGES), none, {"en": 1.0}).collect()} == {1.0}
    lab = spark.createDataFrame([(3, "en"), (5, "de"), (5, None)], "doc_id long, domain string")
    assert mixing.mixed(frame(spark, EDGES), lab, {"en": 0.5, "de": 0.5}).count() == len(EDGES)
    assert mixing.mixed(frame(spark, []), lab, {"en": 1.0}).count() == 0


def test_bag_minhash_is_unbiased():
    rng = np.random.default_rng(0)
    e = rng.integers(0, 2**63, 200).astype(np.uint64)
    a, b = np.ones(200), rng.integers(0, 6, 200).astype(float)
    keep = b > 0
    want = np.minimum(a, b).sum() / np.maximum(a, b).sum()
    same = []
    for k in range(40):
        s = neardup.bag_minhash(np.concatenate([e + np.uint64(k * 977), (e + np.uint64(k * 977))[keep]]), np.concatenate([a, b[keep]]), np.concatenate([np.zeros(200, int), np.ones(keep.sum(), int)]), 2)
        same.append((s[0] == s[1]).mean())
    assert abs(np.mean(same) - want) < 0.02


def brute_classes(bags, threshold=0.8, weighted=True):
    keys = list(bags)
    root = {k: k for k in keys}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in enumerate(keys):
        for b in keys[:i]:
            if linkage.jaccard(bags[a], bags[b], weighted) >= threshold:
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {k: find(k) for k in keys}


def test_near_duplicates_match_brute_force(spark, docs):
    base = words(3, 120)
    group = [(2000 + i, " ".join(base[:i] + ["edit"] + base[i + 1 :])) for i in range(0, 40)]
    chain = [(3000 + i, " ".join(words(4, 200)[i * 8 : i * 8 + 120])) for i in range(8)]  # neighbours are similar, ends aren't
    df = docs.select("doc_id", "text").unionByName(frame(spark, group + chain).select("doc_id", "text"))
    bags = {k: linkage.bag(t) for k, t in texts_of(df).items()}
    want = brute_classes(bags)
    got = {r.doc_id: r.class_id for r in neardup.near_duplicates(df).collect()}
    assert got == want


def test_near_duplicate_edges(spark):
    got = neardup.near_duplicates(frame(spark, EDGES)).collect()
    assert len(got) == len(EDGES)
    by = {r.doc_id: r.class_id for r in got}
    assert by[1] == by[2] == by[6] == 1 and by[3] == 3
    assert neardup.near_duplicates(frame(spark, [])).count() == 0


def test_linkage_crosses_stars(spark):
    """Members that aren't similar to a bucket's first one are still linked with each other."""
    base, far = words(5, 100), words(6, 100)
    items = {1: base, 2: base[:99] + ["x"], 3: far, 4: far[:99] + ["y"], 5: words(7, 100)}
    i = spark.createDataFrame([(k, " ".join(v)) for k, v in items.items()], "id long, text string")
    b = spark.createDataFrame([(k, 9) for k in items], "id long, bucket long")
    _, classes = linkage.linked(b, i, 0.8, True)
    got = {r.id: r.class_id for r in classes.collect()}
    assert got[1] == got[2] == 1 and got[3] == got[4] == 3 and 5 not in got


def test_a_group_of_near_copies_makes_pairs_in_proportion(spark, monkeypatch):
    """Members reach the threshold with some of the others only: pairs once grew with the square of their number."""
    base, n = words(5, 100), 600
    texts = {k: base[: 5 + k * 7 % 85] + [f"x{k}", f"y{k}"] + base[7 + k * 7 % 85 :] for k in range(n)}
    i = spark.createDataFrame([(k, " ".join(v)) for k, v in texts.items()], "id long, text string")
    b = spark.createDataFrame([(k, 9) for k in texts], "id long, bucket long")
    made, verified = [], linkage.verified

    def counted(pairs, *more):
        made.append(pairs.count())
        return verified(pairs, *more)

    monkeypatch.setattr(linkage, "verified", counted)
    _, classes = linkage.linked(b, i, 0.8, True)
    got = {r.id: r.class_id for r in classes.collect()}
    assert got == brute_classes({k: linkage.bag(" ".join(v)) for k, v in texts.items()})
    assert sum(made) < 20 * n, made


def test_substring(spark):
    passage = [f"{a} {b} {c} {d} {e} {f}." for a, b, c, d, e, f in zip(*[iter(words(8, 72))] * 6)]
    own = lambda i: " ".join(" ".join(words(20 + i, 7, k)) + "." for k in range(8))
    rows = [(i, f"{own(i)} {' '.join(passage)} {own(i + 50)}") for i in range(4)] + [(10, own(99)), (11, None), (12, ""), (None, " ".join(passage))]
    got = substring.repeated_spans(frame(spark, rows)).where("kind = 'passage'").collect()
    assert {r.doc_id for r in got} == {0, 1, 2, 3} and {r.doc_id for r in got if not r.removed} == {0}
    text = dict(r for r in rows if r[0] is not None)
    assert all(passage[5].rstrip(".") in text[r.doc_id][r.start : r.end] for r in got)
    para = words(9, 90)
    near = [(1, " ".join(para)), (2, " ".join(para[:88] + ["q", "r"])), (3, " ".join(words(10, 90)))]
    got = substring.repeated_spans(frame(spark, near)).where("kind = 'paragraph'").collect()
    assert {(r.doc_id, r.removed) for r in got} == {(1, False), (2, True)}
    assert substring.repeated_spans(frame(spark, [])).count() == 0


def test_tuned_bands():
    b, r = linkage.tune_bands(0.8, 0.999, 64)
    assert b * r <= 64 and 1 - (1 - 0.8**r) ** b >= 0.999


def test_language(spark, docs):
    got = {r.doc_id: r for r in language.op8_language_id(spark, SF).collect()}
    truth = {r.doc_id: r.lang for r in docs.collect()}
    held = [k for k, r in got.items() if r.held_out]
    assert len(got) == len(truth) and np.mean([got[k].lang_pred == truth[k] for k in held]) > 0.9
    model = language.Model(["the one and only", "der die und das"], ["en", "de"])
    out = {(r.doc_id, r.lang_pred) for r in language.predict(frame(spark, [(1, None), (2, "12 !?"), (3, "the and")]), model).collect()}
    assert {(1, "und"), (2, "und"), (3, "en")} == out
    assert language.Model([], []).predict(["x"]) == (["und"], [0.0])


def test_toxicity(spark):
    rng = np.random.default_rng(1)
    plain = [" ".join(rng.choice([f"n{i}" for i in range(300)], 60)) for _ in range(600)]
    texts = [p + (" you vile toad" if i % 4 == 0 else "") for i, p in enumerate(plain)]
    net = toxicity.train(texts[:400], [int(i % 4 == 0) for i in range(400)])
    s = toxicity.score_texts(net, texts[400:])
    assert np.mean((s >= 0.5) == (np.arange(400, 600) % 4 == 0)) > 0.97
    df = frame(spark, EDGES)
    got = toxicity.flag(df, net).collect()
    assert len(got) == len(EDGES) and all(0 <= r.score <= 1 for r in got)
    assert toxicity.flag(df, net, reject=True).columns == df.columns
    assert (toxicity.score_texts(toxicity.train(["a"], [0]), ["a", ""]) < 0.5).all()


def test_language_model(spark):
    sf = "/root/testdata/sf0.01"  # large enough for the network to learn something
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    got = {r.doc_id: r for r in lm.op10_lm_scoring(spark, sf).collect()}
    text, c = texts_of(docs), collections.Counter()
    toks = {k: t.encode().lower().split() + [b"\n"] for k, t in text.items()}
    for k, w in toks.items():
        if zlib.crc32(str(k).encode()) % 10:
            c.update(w)
    n, d = sum(c.values()), math.log10(sum(c.values()) + 0.1 * (len(c) + 1))
    for k, w in toks.items():
        r = got[k]
        assert (r.n_tokens, r.n_known, r.train_tokens) == (len(w), sum(x in c for x in w), n)
        assert abs(r.base_score - sum(math.log10(c[x] + 0.1) - d for x in w)) < 1e-6
    held = [r for r in got.values() if r.held_out]
    assert sum(r.score for r in held) > sum(r.base_score for r in held) + 0.1 * sum(r.n_tokens for r in held)


def test_language_model_edges(spark):
    df = frame(spark, EDGES)
    got = lm.language_model(df, df).collect()
    assert len(got) == len(EDGES) and all(r.score < 0 for r in got)
    assert lm.language_model(df, frame(spark, [])).count() == len(EDGES)
    assert lm.language_model(frame(spark, []), df).count() == 0


def test_network_probabilities_add_up():
    v = lm.Vocabulary([(lm.END, 5), (b"a", 7), (b"b", 3)], {lm.END: 5, b"a": 7, b"b": 3}, 20, 5, [0.1] * lm.SURFACE)
    p = lm.start_weights(v)
    h = np.random.default_rng(0).normal(size=(1, lm.HIDDEN)).astype(np.float32)
    ids = np.arange(v.n_top + lm.SURFACE)
    total = np.exp(lm.log_probs(p, np.repeat(h, len(ids), 0), ids, v.n_top, v.heads)).sum()
    assert abs(total - 1) < 1e-4


def test_pipeline_run_and_edges(spark, tmp_path, monkeypatch):
    import corpus_pipeline as cp

    from pqledger.scratch import shared_dir

    got = cp.run(spark, SF)
    assert got.count() > 0 and {"doc_id", "start", "n_tokens", "ids_crc32"} <= set(got.columns)
    (tmp_path / "in").mkdir()
    for t in ("labels", "benchmark"):
        spark.read.parquet(f"{SF}/{t}.parquet").write.parquet(str(tmp_path / "in" / f"{t}.parquet"))
    columns = spark.read.parquet(f"{SF}/documents.parquet").schema
    spark.createDataFrame([], columns).write.parquet(str(tmp_path / "in" / "documents.parquet"))
    assert cp.run(spark, str(tmp_path / "in")).count() == 0
    rows = [(1, None, "en", "s", 0), (2, "", "en", "s", 0), (2, "", "en", "s", 0), (None, "some text of nobody", None, None, None)]
    spark.createDataFrame(rows, columns).write.mode("overwrite").parquet(str(tmp_path / "in" / "documents.parquet"))
    kept = cp.run(spark, str(tmp_path / "in")).collect()
    assert {r.doc_id for r in kept} <= {None, 1, 2} and None in {r.doc_id for r in kept}
    assert shared_dir(spark)


def test_pipeline(spark, tmp_path):
    import corpus_pipeline as cp

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    kept = docs
    for name, stage in cp.STAGES[:-1]:
        out = stage(spark, kept, SF)
        assert out.columns == docs.columns, name
        out.write.parquet(str(tmp_path / name))
        kept = spark.read.parquet(str(tmp_path / name))
    ids = {r.doc_id for r in kept.select("doc_id").collect()}
    classes = {r.doc_id: r.class_id for r in neardup.near_duplicates(docs).collect()}
    leaks = {r.doc_id for r in decontaminate.contaminated(docs, spark.read.parquet(f"{SF}/benchmark.parquet")).collect()}
    assert not ids & leaks and len({classes[i] for i in ids}) == len(ids)
    final = cp.STAGES[-1][1](spark, kept, SF)
    assert final.count() == kept.count() and final.agg(F.sum("n_tokens")).first()[0] == final.orderBy(F.desc("start")).select(F.col("start") + F.col("n_tokens")).first()[0]


def test_substring_keeps_the_first_copy(spark):
    # the passage's words also stand one by one in an earlier document, which doesn't hold it
    passage = words(30, 80)
    apart = ". ".join(f"{w}. y{i}" for i, w in enumerate(passage))
    rows = [(0, apart)] + [(i, " ".join(words(30 + i, 60, 1) + passage + words(30 + i, 60, 2))) for i in (1, 2, 3)]
    got = [r for r in substring.repeated_spans(frame(spark, rows)).collect() if r.kind == "passage"]
    text = dict(rows)
    assert {(r.doc_id, r.removed, text[r.doc_id][r.start : r.end]) for r in got} == {(i, i > 1, " ".join(passage)) for i in (1, 2, 3)} and len(got) == 3
    assert {(r.n_words, r.first_doc) for r in got} == {(80, 1)} and len({r.class_id for r in got}) == 1


def test_substring_finds_every_passage_of_fifty_words(spark):
    rng, vocab = np.random.default_rng(4), words(40, 400)
    texts = {i: words(50 + i, 120, 3) for i in range(40)}
    for n in (49, 50, 51, 55, 60, 100):
        passage = list(rng.choice(vocab, n))
        for i in rng.choice(40, 2, replace=False).tolist():
            at = int(rng.integers(1, len(texts[i])))
            texts[i] = texts[i][:at] + passage + texts[i][at:]
    texts |= {40: texts[3], 41: texts[5][10:90], 42: texts[5][40:] + texts[7][:70]}
    places = collections.defaultdict(list)
    for i, t in sorted(texts.items()):
        for p in range(len(t) - 49):
            places[tuple(t[p : p + 50])].append((i, p))
    want = {True: collections.defaultdict(set), False: collections.defaultdict(set)}
    for at in places.values():
        for i, p in at if len({i for i, _ in at}) > 1 else []:
            want[(i, p) != at[0]][i].update(range(p, p + 50))
    got = {True: collections.defaultdict(set), False: collections.defaultdict(set)}
    for r in substring.repeated_spans(frame(spark, [(i, " ".join(t)) for i, t in texts.items()])).where("kind = 'passage'").collect():
        text = " ".join(texts[r.doc_id])
        first = len(text[: r.start].split())
        assert len(text[r.start : r.end].split()) == r.n_words
        got[r.removed][r.doc_id].update(range(first, first + r.n_words))
    assert got == want and len(want[True]) >= 7


def test_substring_compares_short_lines(spark):
    line = words(60, 30)
    rows = [(1, " ".join(line)), (2, " ".join(words(61, 9)) + "\n" + " ".join(line[:-1] + ["x"])), (3, "a b c d e"), (4, "q\na b c d e"), (5, "a b c d"), (6, "a b c d")]
    got = substring.repeated_spans(frame(spark, rows)).collect()
    assert {(r.doc_id, r.kind, r.first_doc, r.removed) for r in got} == {(1, "paragraph", 1, False), (2, "paragraph", 1, True), (3, "paragraph", 3, False), (4, "paragraph", 3, True)}


def test_substring_within_one_document(spark):
    passage, line = words(70, 60), " ".join(words(71, 12))
    rows = [(1, " ".join(words(72, 70) + passage + words(73, 70) + passage)), (2, f"{line}\na b c d e\n{line}"), (3, "word " * 3000), (4, "few " * 60)]
    got = substring.repeated_spans(frame(spark, rows)).collect()
    text = dict(rows)
    assert sorted((r.removed, text[1][r.start : r.end]) for r in got if r.doc_id == 1 and r.kind == "passage") == [(i, " ".join(passage)) for i in (False, True)]
    assert sorted((r.start, r.removed) for r in got if r.doc_id == 2) == [(0, False), (len(line) + 11, True)]
    # what goes of a text that repeats one word leaves its first window whole
    assert [(r.start, r.n_words) for r in got if r.doc_id == 3 and r.removed] == [(5 * 50, 2950)] and not [r for r in got if r.doc_id == 4]
    assert all(r.first_doc == r.doc_id for r in got)


def test_decontamination_of_long_copies_with_one_changed_slot(spark):
    item = words(80, 200)
    item[20], item[60], item[190] = "25", "25", "25"
    rows = [(1, " ".join(item)), (2, " ".join(item[:190] + ["26"] + item[191:])), (3, " ".join(item[50:66] + words(81, 90))), (4, " ".join(words(82, 200)))]
    b = spark.createDataFrame([(1, " ".join(item))], "item_id long, text string")
    assert {(r.doc_id, r.longest_run) for r in decontaminate.contaminated(frame(spark, rows), b).collect()} == {(1, 200), (2, 190), (3, 16)}
    two = decontaminate.judge([0, 5, 30, 35], 60, [(2, 7, 8), (32, 7, 9)])
    assert two == (26, 13, True)  # runs that don't touch are each consistent


def test_decontamination_of_other_cases_and_short_items(spark):
    item = " ".join(words(90, 20)) + " and 12 more"
    rich = "He met Ann Bob Cid Dan Eve Flo Gus Hal 1 2 3 4 5"
    rows = [(1, item.upper()), (2, f"It said: {item.title()}."), (3, item.upper().replace("12", "77")), (4, f"yes. {rich} so"), (5, "We ask: who wrote the red book? Now"), (6, "who wrote the blue book"), (7, rich.replace("Ann", "Zoe").replace("1 2 3", "3 1 9"))]
    b = spark.createDataFrame([(1, item), (2, rich), (3, "Who wrote the red book?"), (4, "red book")], "item_id long, text string")
    assert {(r.doc_id, r.item_id) for r in decontaminate.contaminated(frame(spark, rows), b).collect()} == {(1, 1), (2, 1), (3, 1), (4, 2), (5, 3)}


def test_pipeline_judges_rows_by_their_own_texts(spark, tmp_path):
    import corpus_pipeline as cp

    a, b, c = (" ".join(words(i, 60)) for i in (95, 96, 97))
    got = cp.drop_near_duplicates(spark, frame(spark, [(1, a), (1, b), (-2, a), (None, a), (None, c), (None, c)]), "").collect()
    assert sorted((r.doc_id or 0, r.text) for r in got) == sorted([(-2, a), (1, b), (0, c)]) and len(got[0]) == 6
    spark.createDataFrame([(1, c)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    got = cp.drop_benchmark_leaks(spark, frame(spark, [(1, a), (1, c), (None, b), (None, c), (2, None)]), str(tmp_path)).collect()
    assert {(r.doc_id, r.text) for r in got} == {(1, a), (None, b), (2, None)}


def test_html_loses_no_text():
    read = lambda page: [b.text for b in html.blocks_of(page)]
    assert read("<html><head><title>T</title><body><p>One.<p>Two.") == ["One.", "Two."]
    assert read("<head><title>T</title><meta x>Bare text<p>Two.") == ["Bare text", "Two."]
    assert read("<p>One.<svg><path d=1><p>Two.</p><p>Three.</p>") == ["One.", "Two.", "Three."]
    assert read("<p>One <svg><text>drawn</text></svg> more.</p>") == ["One more."]
    assert read("<p title=don't>It's here.</p><p>And isn't gone.</p>") == ["It's here.", "And isn't gone."]
    assert read("<p>&<b>amp;</b> &lt;b&gt; &amp;amp;</p>") == ["&amp; <b> &amp;"]
    assert read("<p>a<script>if (1 < 2) '<p>no</p>'</script>b</p><style>p{}</style><!-- no --><p>c") == ["ab", "c"]
    assert read("<template>no</template><noscript>no</noscript><p>yes") == ["yes"]
    many = read("<div>" * 3000 + "".join(f"<p>Line {i}." for i in range(5000)))
    assert many == [f"Line {i}." for i in range(5000)]


def test_html_table_edges(spark):
    schema = "page_id long, url string, html string, text string, n_chars string"
    model = html.default_model()
    assert html.extract(spark.createDataFrame([], schema), model).count() == 0
    long = "<article><h1>A title.</h1>" + "<p>A sentence of the article, with words.</p>" * 4000 + "</article>"
    got = html.extract(spark.createDataFrame([(1, "u", long, "x", "y")], schema), model).first()
    assert got.text.count("\n") == 4000 and got.n_chars == len(got.text)


def test_crf_against_enumeration():
    import itertools

    rng = np.random.default_rng(3)
    w, trans = rng.normal(size=(6, 2)), rng.normal(size=(2, 2))
    rows, y = [[0, 2], [1], [3, 4, 5], [2, 2], [0, 5]], [0, 1, 1, 0, 1]
    e = np.array([w[r].sum(0) for r in rows])
    paths = list(itertools.product((0, 1), repeat=5))
    total = lambda p: sum(e[i, k] for i, k in enumerate(p)) + sum(trans[a, b] for a, b in itertools.pairwise(p))
    s = np.array([total(p) for p in paths])
    z, one, two = html.marginals(e, trans)
    share = np.exp(s - np.log(np.exp(s).sum()))
    assert np.isclose(z, np.log(np.exp(s).sum()))
    for i in range(5):
        assert np.isclose(one[i, 1], sum(q for p, q in zip(paths, share, strict=True) if p[i]))
    for i in range(4):
        assert np.isclose(two[i, 0, 1], sum(q for p, q in zip(paths, share, strict=True) if p[i : i + 2] == (0, 1)))
    assert tuple(html.Crf(w, trans).decode(rows)) == paths[int(s.argmax())]
    loss, _, gt = html.gradients(w, trans, rows, y)
    assert np.isclose(loss, z - total(y))
    for a, b in itertools.product((0, 1), repeat=2):
        moved = trans.copy()
        moved[a, b] += 1e-6
        assert np.isclose((html.gradients(w, moved, rows, y)[0] - loss) / 1e-6, gt[a, b], atol=1e-4)
