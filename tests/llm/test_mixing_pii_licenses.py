import re
import random

import pytest
from compare import compare, duck
from conftest import ODD_ROWS, SF

from caseflow.llm import licenses, mixing, pii, queries, tables
from pyspark.sql import functions as F


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_query_matches_oracle(spark, name):
    problems, _ = compare(queries.queries()[name](spark, SF), duck(SF), queries.oracle_sql()[name])
    assert not problems, problems


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_odd_rows_match_oracle(spark, stored, name):
    rows = [(i, t, "en", s) for (i, t), s in zip(ODD_ROWS, ["a", "b", None, "a", "c", "c"] * 3) if i is not None and t is not None]
    rows = list({r[0]: r for r in rows}.values())
    folder = stored(rows)
    con = duck("/nowhere")
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{folder}/documents.parquet/*.parquet')")
    problems, _ = compare(queries.queries()[name](spark, folder), con, queries.oracle_sql()[name])
    assert not problems, problems


def test_mix_of_odd_rows_and_small_bins(spark, make):
    rnd = random.Random(3)
    rows = [(i, "w " * rnd.randint(0, 60), "en", rnd.choice(["a", "b", "c", "d", None])) for i in range(800)]
    rows += [(1, "w w", "en", "a"), (None, "w w w", "en", "b"), (7, None, "en", "z")]
    sized = mixing.measured(make(rows))
    one, fine = (mixing.mix(sized, docs_per_bin=n).collect() for n in (1 << 30, 5))
    assert sorted(map(str, one)) == sorted(map(str, fine))
    total, by = sum(r["size"] for r in one), {}
    for r in one:
        assert r["taken"] <= 2 * r["size"] and (r["size"] == 0 or r["taken"] // r["size"] in (r["epochs"], r["epochs"] + 1))
        by.setdefault(r["source"], [0, r["target"], r["source_size"]])[0] += r["taken"]
    assert abs(sum(t for _, t, _ in by.values()) - 1.5 * total) < 1e-6
    for taken, target, size in by.values():
        assert target <= 2 * size + 1e-9 and abs(taken - target) <= 60
    assert mixing.mix(mixing.measured(make([]))).count() == 0
    assert [r["taken"] for r in mixing.mix(mixing.measured(make([(1, None), (2, " ")]))).collect()] == [0, 0]


def test_rest_that_ends_with_a_bin_ends_the_draw(spark, make):
    # one source of equal documents; with a bin for each, the first 22 keys end a bin and meet the rest exactly
    sized = mixing.measured(make([(i, "w") for i in range(64)]))
    assert mixing.mix(sized, docs_per_bin=1, share=22 / 64).agg({"taken": "sum"}).first()[0] == 22


def brute_pii(t):
    found = []
    luhn = lambda d: sum((x if i % 2 == 0 else x * 2 - 9 * (x > 4)) for i, x in enumerate(map(int, reversed(d)))) % 10 == 0
    for kind, pattern in (("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"), ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"),
                          ("card", r"[0-9]([\x20-]?[0-9])+"), ("phone", r"\+[0-9][\x20().0-9-]+[0-9]")):
        for m in re.finditer(pattern, t or ""):
            digits = re.sub("[^0-9]", "", m[0])
            if kind == "ip" and max(map(int, m[0].split("."))) > 255 or kind == "card" and not (13 <= len(digits) <= 19 and luhn(digits)) \
                    or kind == "phone" and not 9 <= len(digits) <= 15:
                continue
            found.append(f"{kind}:{m.start()}:{m.end()}")
    return found


def test_pii_spans_are_those_of_the_plain_patterns(spark, make):
    rnd = random.Random(9)
    bits = ["a", "B.", "@", "x@y.z", "_", "%", " ", "-", ".", "+", "1", "12", "192.168.0.1", "256.1.1.1", "4111 1111 1111 1111", "(", ")", "+1 (555) 123-4567",
            "é", "😀", "\n", "001.002.3.4", "1.2.3.4.5.6.7.8", "a@b.c_d@e.f"]
    rows = [(i, "".join(rnd.choice(bits) for _ in range(rnd.randint(0, 14)))) for i in range(3000)] + [(5000 + i, t) for i, (_, t) in enumerate(ODD_ROWS)]
    got = {}
    for r in pii.detect(make(rows)).collect():
        got.setdefault(r["doc_id"], [f"{s['kind']}:{s['start']}:{s['end']}" for s in r["pii_spans"] if s["kind"] in pii.BASE])
    for i, t in rows:
        assert got[i] == brute_pii(t), t


def test_added_spans_scores_and_redaction(spark, make):
    text = "My bank account: DE89 3704 0044 0532 0130 00, or mail me@x.org. Not DE00 3704 0044 0532 0130 00"
    row = pii.redact(pii.detect(make([(1, text)]))).first()
    assert [(s["kind"], s["match"]) for s in row["pii_spans"]] == [("email", "me@x.org"), ("iban", "DE89 3704 0044 0532 0130 00")]
    assert [round(s["score"], 3) for s in row["pii_spans"]] == [1.0, 0.9]
    assert row["text"] == "My bank account: [iban], or mail [email]. Not DE00 3704 0044 0532 0130 00"
    assert pii.detect(make([(1, text)]), min_score=0.95).selectExpr("size(pii_spans) AS n").first()["n"] == 1
    assert pii.detect(make([])).count() == 0
    long = pii.detect(make([(1, "1-" * 200000), (2, "a" * 500000), (3, "a." * 100000 + "@" + "b." * 100000)])).collect()
    assert len(long) == 3


@pytest.mark.parametrize("text,kinds", [
    ('token = "0b96a8c8d79c4a5085c919698889f59b72ab7bb6" of', [("secret", 0.85)]), ("0b96a8c8d79c4a5085c919698889f59b72ab7bb6", []),
    ("my password: Tr0ub4dor-3x-and-more-of-it", [("secret", 0.85)]), ("api_key=" + "a1b2c3" * 40, []), ("secret internationalisation-and-such", []),
    ("card 4111 1111 1111 1111 or 4111111111111111", [("card", 0.8), ("card", 0.8)]), ("9.9.9.9, host 1.2.3.4", [("ip", 0.7), ("ip", 0.7)]),
])
def test_secrets_and_context(spark, make, text, kinds):
    got = pii.detect(make([(1, text)])).first()["pii_spans"]
    assert [(s["kind"], round(s["score"], 3)) for s in got] == kinds
    assert all(text[s["start"]:s["end"]] == s["match"] for s in got)


def test_contexts_are_those_of_the_text_around(spark, make):
    rnd = random.Random(5)
    bits = ["mail ", "call ", "1.2.3.4", " a@b.cc ", "x" * 37, "é😀 ", "+1 555 123 4567", "\n", "host", "12 ", "tel "]
    rows = [(i, "".join(rnd.choice(bits) for _ in range(rnd.randint(0, 60)))) for i in range(400)]
    for r in pii.detect(make(rows)).collect():
        for s in r["pii_spans"]:
            [kind] = [k for k in pii.KINDS if k.name == s["kind"]]
            around = (r["text"][max(0, s["start"] - 40):s["start"]] + " " + r["text"][s["end"]:s["end"] + 40]).lower()
            assert round(s["score"] - kind.base_score, 3) == (0.1 if re.search("|".join(kind.context), around) else 0.0)


def test_texts_full_of_matches_take_little_more_than_linear_time(spark, make):
    import time
    times = []
    for size in (500_000, 5_000_000):
        rows = tables.written(make([(1, "12, " * (size // 4)), (2, "10.0.0.1 " * (size // 50))]), "test-long")
        began = time.time()
        got = {r.doc_id: r.n for r in pii.detect(rows).selectExpr("doc_id", "size(pii_spans) AS n").collect()}
        times.append(time.time() - began)
        assert got == {1: 0, 2: size // 50}
    assert times[1] < 40


def test_pii_replaces_a_column_of_its_name_and_keeps_others(spark, make):
    docs = make([(1, "a@b.cc"), (None, None)]).withColumn("pii_spans", F.lit("clash")).withColumn("score", F.lit("mine"))
    got = {r.doc_id: (len(r.pii_spans), r.score) for r in pii.detect(docs).collect()}
    assert got == {1: (1, "mine"), None: (0, "mine")}


@pytest.mark.parametrize("text,license", [
    ("Licensed under the GNU General Public License, version 3", "GPL-3.0"), ("Licensed under the GNU General Public License, version 2", "GPL-2.0"),
    ("This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.", "CC-BY-SA-4.0"),
    ("Licensed under CC BY-NC 4.0", "CC-BY-NC-4.0"), ("Released under the GNU Lesser General Public License, version 3", "LGPL-3.0"),
    *[(licenses.TEXTS[name], name) for name in licenses.TEXTS],
    *[("prose\n\n" + "\n".join("# " + x for x in licenses.TEXTS[name].split("\n")) + "\n\nimport os", name)
      for name in ("LGPL-2.1", "GPL-2.0", "AGPL-3.0", "GPL-3.0")],
])
def test_one_licence_a_notice(spark, make, text, license):
    assert {r["license"] for r in licenses.scan(make([(1, text)])).collect()} == {license}


def test_licences_of_odd_tables(spark, stored, make, tmp_path):
    notice = "Released under the MIT License"
    rows = [(1, notice), (1, "prose"), (1, notice), (None, "licensed under the ISC License"), (None, None), (2, None), (2, "")]
    got = sorted(((r.doc_id, r.license, r.licenses) for r in licenses.op10(spark, stored(rows)).collect()), key=str)
    assert got == sorted([(1, "MIT", "MIT"), (None, "ISC", "ISC"), (2, None, "")], key=str)
    make([]).write.parquet(str(tmp_path / "none" / "documents.parquet"))
    assert licenses.op10(spark, str(tmp_path / "none")).collect() == [] and pii.op9(spark, str(tmp_path / "none")).collect() == []
    clash = make(rows).withColumns({c: F.lit("clash") for c in ("unit", "words", "license", "dice", "bigrams", "made", "key", "grams")})
    assert sorted(map(str, licenses.scan(clash).collect())) == sorted(map(str, licenses.scan(make(rows)).collect()))


def test_license_texts(spark, make):
    mit = licenses.TEXTS["MIT"]
    docs = make([(1, mit), (2, f"# header\n\n{mit.upper()}\n\ncode"), (3, "Released under the MIT license!\nprose"), (4, mit[:len(mit) // 3]),
                 (5, None), (6, ""), (7, licenses.TEXTS["BSD-2-Clause"].replace("\n", " ")), (8, "licensed under the license"), (3, "prose")])
    found = {}
    for r in licenses.scan(docs).collect():
        found.setdefault(r["doc_id"], set()).add(r["license"])
    assert found[1] == found[2] == found[3] == {"MIT"} and "BSD-2-Clause" in found[7] and not {4, 5, 6, 8} & set(found)


def test_licenses_over_paragraphs_and_within_lines(spark, make):
    prose = "Some words of the text in which it stands, and more of them. " * 12
    cut = lambda name, *at: re.sub("(" + "|".join(at) + ")", r"\n\n\1", licenses.TEXTS[name])      # noqa: E731
    mit = cut("MIT", "The above copyright", 'THE SOFTWARE IS PROVIDED')
    bsd = "\n".join("// " + x for x in cut("BSD-3-Clause", "1. ", "2. ", "3. ", "THIS SOFTWARE IS").split("\n"))
    apache = "\n".join("# " + x for x in cut("Apache-2.0", "You may obtain", "Unless").split("\n"))
    docs = make([(1, f"{prose}\n\n{mit}\n\n{prose}"), (2, f"{prose}\n{bsd}\nint main() {{}}"), (3, f"#!/bin/sh\n{apache}\n\nimport os\n{prose}"),
                 (4, f"{prose} It is released under the MIT License, see there. {prose}"), (4, f"{prose} It is released under the MIT License, see there. {prose}"),
                 (5, f"{prose} This work is licensed under the licence of its authors. {prose}"), (6, f"{prose}\n\n{mit[:len(mit) // 3]}\n\n{prose}"),
                 (7, f"{prose} Licensed under the GNU General Public License, version 3, and {prose}distributed under the ISC License. {prose}"),
                 (None, f"{prose}\n\n{mit}"), (8, f"{prose} license")])
    found = {}
    for r in licenses.scan(docs).collect():
        of = found.setdefault(r["doc_id"], {})
        of[r["license"]] = max(of.get(r["license"], 0.0), r["dice"])
    assert found.pop(1) == found.pop(4) == found.pop(None) == {"MIT": 1.0} and found.pop(2) == {"BSD-3-Clause": 1.0} and found.pop(3) == {"Apache-2.0": 1.0}
    assert found == {7: {"GPL-3.0": 1.0, "ISC": 1.0}}


def test_windows_are_the_best_of_all(spark, make):
    rnd = random.Random(4)
    forms = [t for t in licenses.templates() if len(t[1]) < 12]
    rows = []
    for i in range(24):
        words = []
        for _ in range(rnd.randint(1, 3)):
            words += rnd.choices(["so", "the", "under", "license", "licensed"], k=rnd.randint(0, 4)) + [w for w in rnd.choice(forms)[1] if rnd.random() < 0.93]
        rows.append((i, " ".join(words)))
    got = {}
    for r in licenses.windows(make(rows)).collect():
        got[r["doc_id"]] = max(got.get(r["doc_id"], 0.0), r["dice"])
    for i, text in rows:
        made, best = [*zip(text.split(), text.split()[1:])], 0.0
        for (_, words), name in zip(licenses.templates(), licenses.template_names()):
            grams, named = [*zip(words, words[1:])], {*zip(name, name[1:])}
            if len(grams) > 3 * len(made):
                continue
            for a in range(len(made)):
                for b in range(a + 1, min(len(made), a + len(grams) * 2) + 1):
                    common = sum(min(made[a:b].count(g), grams.count(g)) for g in set(grams))
                    dice = 2 * common / (b - a + len(grams))
                    if dice > best and (not named or 2 * sum(g in made[a:b] for g in named) > len(named)):
                        best = dice
        assert got.get(i, 0.0) == pytest.approx(best if best >= 0.8 else 0.0), text


def test_size_bounds_hold():
    for n in range(1, 60):
        low, high = licenses.size_bounds(n)
        for m in range(1, 120):
            assert (2 * min(n, m) / (n + m) >= licenses.THRESHOLD) == (low <= m <= high)
