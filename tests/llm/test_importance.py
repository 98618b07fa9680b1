"""Importance resampling against SQL and against a plain Python version."""

import hashlib
import math
import re
import zlib
from collections import Counter

import duckdb

from pqledger.llm import importance

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, score string, rank string, _w string"


def brute(docs, target):
    def features(text):
        t = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        ws = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", t)
        return len(ws), ws + [f"{a} {b}" for a, b in zip(ws, ws[1:], strict=False)]

    of = lambda f: zlib.crc32(f.encode()) % 10000
    s, t = Counter(), Counter()
    for _, x in docs:
        s.update(map(of, features(x)[1]))
    for x in target:
        t.update(map(of, features(x)[1]))
    out = []
    for i, x in docs:
        n, fs = features(x)
        gain = [math.floor(1000 * math.log((t[of(f)] + 1) * (s.total() + 10000) / ((s[of(f)] + 1) * (t.total() + 10000)))) for f in fs]
        h = int(hashlib.sha256(f"7:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        w = math.floor(sum(gain) / len(fs)) if fs else 0
        out.append((i, n, len(fs), w, w + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))))
    fit = sorted((r for r in out if r[1] >= 20), key=lambda r: (-r[4], r[0] is None, r[0] or 0))
    ranks = Counter((r[0], r[2], r[3], r[4], k + 1) for k, r in enumerate(fit[: 25 * len(fit) // 100]))
    return Counter(r[:1] + r[2:] for r in out), ranks


def check(spark, docs, target):
    df = spark.createDataFrame([(i, t, "s", "r", "w") for i, t in docs], DOCS)
    got = importance.resampled(df, spark.createDataFrame([(t,) for t in target], "text string")).collect()
    rows, ranks = brute(docs, target)
    assert Counter((r.doc_id, r.n_features, r.weight, r.score) for r in got) == rows
    assert Counter((r.doc_id, r.n_features, r.weight, r.score, r["rank"]) for r in got if r["rank"] is not None) == ranks
    return got


def test_same_as_sql(spark):
    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    want = con.execute(importance.ORACLE["op11_importance_resampling"]).fetchall()
    got = importance.op11_importance_resampling(spark, SF).select("doc_id", "n_features", "weight", "score", "rank", "n_words").collect()
    assert sorted(map(tuple, got)) == sorted(want)


def test_edges(spark):
    long = " ".join(f"Wort{i % 211} ÄÖ{i % 7}É Iİ x" for i in range(8000))
    docs = [(1, None), (2, ""), (3, "a b"), (3, "a b"), (None, long[:400]), (None, "z " * 30), (5, long), (6, " \n\t\x00 "), (7, "the cat sat " * 20), (7, "the cat sat " * 20), (-8, "The,cat;sat[on]the{mat} 12_34 " * 9)]
    check(spark, docs, ["the cat sat on the mat", None, ""])
    check(spark, docs, [])
    assert check(spark, [], ["x y"]) == []


def test_ties_go_to_smaller_ids_and_quota(spark):
    same = [(i, "one two three four " * 6) for i in range(1, 90)] + [(4, "one two three four " * 6)] * 3
    got = check(spark, same, ["one two"])
    assert sum(r["rank"] is not None for r in got) == 25 * len(same) // 100
