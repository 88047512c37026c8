import hashlib
import zlib

import pytest
from compare import compare, duck
from conftest import ODD_ROWS, SF

from caseflow.llm import merkle
from pyspark.sql import functions as F

ROWS = [*ODD_ROWS, (14, "line\nbreaks\n", None, None), (15, "a\nb", "de", None), (16, "p\nq", "de", "z"), (16, "p\nq", "de", "z"),
        (17, "\n", "de", "Z"), (18, "x\ny", "de", "é"), *[(20 + i, f"t{i}\nu", "en", "many") for i in range(29)]]


def H(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf_of(row, text):
    return H(*["-" if v is None else f"{len(str(v).encode())}:{v}" for v in (row["doc_id"], row["source"], row["lang"], row["n_chars"], text)])


def tree(hashes, arity):
    """Root, and per leaf the (left, right) siblings of each level."""
    if not hashes:
        return None, []
    levels, paths = [hashes], [[] for _ in hashes]
    while len(levels[-1]) > 1:
        now = levels[-1]
        for i, path in enumerate(paths):
            at = i // arity ** (len(levels) - 1)
            first = at - at % arity
            path.append(("".join(now[first:at]), "".join(now[at + 1:first + arity])))
        levels.append([H(*now[i:i + arity]) for i in range(0, len(now), arity)])
    return levels[-1][0], paths


def brute(rows):
    groups = {}
    for r in rows:
        groups.setdefault(r["source"], []).append((r["doc_id"], leaf_of(r, r["text"]), r))
    names = sorted(groups, key=lambda s: (s is not None, (s or "").encode()))
    for members in groups.values():
        members.sort(key=lambda m: (m[0] is not None, m[0] or 0, m[1]))
    made = {s: tree([m[1] for m in groups[s]], 3) for s in names}
    root, tops = tree([made[s][0] for s in names], 3)
    out = []
    for s, top in zip(names, tops):
        for (doc_id, leaf, r), path in zip(groups[s], made[s][1]):
            whole = path + top
            node = leaf
            if doc_id is not None and zlib.crc32(str(doc_id).encode()) % 2 == 0 and r["text"] is not None:
                node = leaf_of(r, r["text"].replace("\n", ""))
            for a, b in whole:
                node = H(a, node, b)
            out.append((doc_id, leaf, made[s][0], root, H(*[a + b for a, b in whole]), node, node == root))
    return out


def test_against_brute_force(spark, make, stored):
    rows = make(ROWS).collect()
    assert sorted(map(tuple, merkle.op11(spark, stored(ROWS)).collect()), key=str) == sorted(brute(rows), key=str)


def test_matches_sql(spark):
    problems, n = compare(merkle.op11(spark, SF), duck(SF), merkle.OP11_SQL)
    assert not problems and n > 0


@pytest.mark.parametrize("rows", [[], [(1, "a\nb")], [(None, None)], [(1, "a"), (1, "a")]])
def test_small_tables(spark, make, stored, rows):
    out = merkle.op11(spark, stored(rows, 1))
    assert out.columns == ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
    assert sorted(map(tuple, out.collect()), key=str) == sorted(brute(make(rows).collect()), key=str)


@pytest.mark.parametrize("arity", [2, 4])
def test_other_arities_and_clashing_columns(spark, arity):
    data = [(g, k, H(g, str(k)), "kept", k * 2, "x") for g, n in (("a", 17), ("b", 1), ("c", 4)) for k in range(n)]
    rows = spark.createDataFrame(data, "grp string, key long, hash string, rows string, _at long, tree string").repartition(5)
    made = merkle.manifest(rows.withColumn("left", F.lit("mine")), "grp", ["key"], arity)
    trees = {g: tree([d[2] for d in data if d[0] == g], arity) for g in "abc"}
    root, _ = tree([trees[g][0] for g in "abc"], arity)
    assert made.root == root
    assert {(r.grp, r.rows, r.subroot) for r in made.subroots.collect()} == {(g, n, trees[g][0]) for g, n in (("a", 17), ("b", 1), ("c", 4))}
    folded = made.proofs.select("grp", "rows", merkle.fold(F.col("hash"), F.col("proof")).alias("root")).collect()
    assert len(folded) == 22 and {r.root for r in folded} == {root} and {r["rows"] for r in folded} == {"kept"}


def test_other_columns_of_documents_are_ignored(spark, make, tmp_path):
    rows = make(ROWS)
    clash = rows.withColumns({c: F.lit("clash") for c in ("hash", "place", "nodes", "tree", "_at", "_part", "left", "proof", "leaf", "changed")})
    clash.write.parquet(str(tmp_path / "documents.parquet"))
    assert sorted(map(tuple, merkle.op11(spark, str(tmp_path)).collect()), key=str) == sorted(brute(rows.collect()), key=str)
