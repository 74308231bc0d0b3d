import hashlib

import pytest
from pyspark.sql import functions as F

from scriptorium.llm import merkle

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def leaf_of(row):
    return sha("".join("-" if row[f] is None else f"{len(str(row[f]).encode())}:{row[f]}" for f in merkle.FIELDS))


def levels_of(leaves, fanout):
    out = [leaves]
    while len(out[-1]) > 1:
        out.append([sha("".join(out[-1][i : i + fanout])) for i in range(0, len(out[-1]), fanout)])
    return out


def path_of(levels, i, fanout):
    """The siblings of leaf i by level, with the place of its own in each run."""
    out = []
    for level in levels[:-1]:
        run = level[i - i % fanout : i - i % fanout + fanout]
        out.append((run[: i % fanout], run[i % fanout + 1 :]))
        i //= fanout
    return out


def folded(own, path):
    for left, right in path:
        own = sha("".join(left) + own + "".join(right))
    return own


def brute(rows, fanout):
    """(doc_id, leaf, subroot, root, proof) of every row."""
    groups = {}
    for r in sorted(rows, key=lambda r: (r["doc_id"] is not None, r["doc_id"] or 0, leaf_of(r))):
        groups.setdefault(r["lang"], []).append(r)
    ordered = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    trees = {g: levels_of([leaf_of(r) for r in groups[g]], fanout) for g in ordered}
    top = levels_of([trees[g][-1][0] for g in ordered], fanout)
    out = []
    for k, g in enumerate(ordered):
        for i, r in enumerate(groups[g]):
            path = path_of(trees[g], i, fanout) + path_of(top, k, fanout)
            assert folded(leaf_of(r), path) == top[-1][0]
            out.append((r["doc_id"], leaf_of(r), trees[g][-1][0], top[-1][0], sha("".join("".join(a) + "".join(b) for a, b in path))))
    return out


def made(manifest, limit=merkle.BROADCAST_BYTES):
    found = merkle.proofs(manifest, limit).withColumn("again", merkle.folded_root(F.col("leaf"))).withColumn("other", merkle.folded_root(merkle.digest(F.lit("x"))))
    rows = found.select("doc_id", F.hex("leaf").alias("leaf"), F.hex("subroot").alias("subroot"), merkle.proof_digest().alias("proof"), "again", "other").collect()
    root = manifest.root.hex() if manifest.root else None
    assert all(r.again == root and r.other != root for r in rows)
    return [(r.doc_id, r.leaf.lower(), r.subroot.lower(), root, r.proof) for r in rows]


def by(rows):
    return sorted(rows, key=repr)


@pytest.fixture(scope="module")
def rows():
    langs = ["en"] * 70 + ["de"] * 9 + ["fr"] * 8 + ["ü"] + [None] * 2
    out = [{"doc_id": i * 31 % 90, "text": f"Text {i} Ä", "lang": lang, "source": "s" if i % 3 else None, "n_chars": i} for i, lang in enumerate(langs)]
    return out + [{"doc_id": 200 + i, "text": "x", "lang": f"l{i:02d}", "source": "", "n_chars": None} for i in range(12)]


@pytest.mark.parametrize(("fanout", "limit"), [(2, 0), (3, 2000), (8, 0), (8, merkle.BROADCAST_BYTES)])
def test_proofs_by_brute_force(spark, rows, fanout, limit):
    """All levels shuffled, some broadcast, all broadcast."""
    docs = spark.createDataFrame([tuple(r[c.split(" ")[0]] for c in SCHEMA.split(", ")) for r in rows], SCHEMA).repartition(5)
    assert by(made(merkle.build(docs, kept={"doc_id": F.col("doc_id")}, fanout=fanout), limit)) == by(brute(rows, fanout))


@pytest.mark.parametrize("n", [1, 2, 8, 9, 64, 65])
def test_sizes_at_the_borders(spark, n):
    rows = [{"doc_id": i, "text": f"t{i}", "lang": "en", "source": "s", "n_chars": 1} for i in range(n)]
    docs = spark.createDataFrame([tuple(r[c.split(" ")[0]] for c in SCHEMA.split(", ")) for r in rows], SCHEMA)
    manifest = merkle.build(docs, kept={"doc_id": F.col("doc_id")})
    assert by(made(manifest)) == by(brute(rows, 8))
    assert manifest.trees.select("tree", "lang", "n").collect() == [(0, "en", n)]


def test_a_change_shows_in_its_own_row_only(spark, rows):
    """Neither fields nor null and empty can be exchanged for one another."""
    docs = spark.createDataFrame([tuple(r[c.split(" ")[0]] for c in SCHEMA.split(", ")) for r in rows], SCHEMA)
    told = merkle.leaf([F.when(F.col("doc_id") == 5, F.lit("Text")).otherwise(F.col("text")) if f == "text" else F.col(f) for f in merkle.FIELDS])
    manifest = merkle.build(docs, kept={"doc_id": F.col("doc_id"), "told": told})
    got = merkle.proofs(manifest).select("doc_id", (merkle.folded_root(F.col("told")) == manifest.root.hex()).alias("ok")).collect()
    assert [r.doc_id for r in got if not r.ok] == [5]
    pairs = [("1", "23", None), ("12", "3", None), (None, "123", ""), ("", "123", None), ("-", "123", None)]
    some = spark.createDataFrame(pairs, "a string, b string, c string").select(F.hex(merkle.leaf([F.col(c) for c in "abc"])).alias("h"))
    assert some.distinct().count() == len(pairs)


def test_odd_rows(spark, odd_docs, no_docs):
    docs = odd_docs.withColumns({"lang": F.when(F.col("doc_id") < 4, "en"), "source": F.lit(None).cast("string"), "n_chars": F.col("length")})
    rows = [r.asDict() for r in docs.collect()]
    got = made(merkle.build(docs, kept={"doc_id": F.col("doc_id")}))
    want = brute(rows, 8)
    assert sorted((r[1:] for r in got)) == sorted(r[1:] for r in want)
    empty = merkle.build(no_docs.withColumns({"source": F.lit(""), "n_chars": F.lit(1)}), kept={"doc_id": F.col("doc_id")})
    assert empty.root is None and made(empty) == []
