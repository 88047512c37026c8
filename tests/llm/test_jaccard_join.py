import random
import re
import weakref
from types import SimpleNamespace

import numpy as np
import pyarrow as pa
import pytest
from conftest import ODD_ROWS, SF
from hypothesis import given, settings
from hypothesis import strategies as st

from caseflow.llm import jaccard_join as J
from caseflow.llm import tables, words


def shingles(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return frozenset(tuple(w[k:k + 5]) for k in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])


def brute(rows):
    sets = [shingles(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            if sets[a] and sets[b]:
                both = len(sets[a] & sets[b])
                if 100 * both >= 80 * (len(sets[a]) + len(sets[b]) - both):
                    root[find(a)] = find(b)
    low = {}
    for k, (i, _) in enumerate(rows):
        if i is not None:
            low[find(k)] = min(low.get(find(k), i), i)
    return sorted(((i, len(sets[k]), low.get(find(k)) if sets[k] else i) for k, (i, _) in enumerate(rows)), key=str)


def got(docs):
    return sorted((tuple(r)[:3] for r in J.join(docs)[0].collect()), key=str)


def test_table(spark):
    rows = [(r["doc_id"], r["text"]) for r in tables.read(spark, SF, "documents").collect()]
    assert sorted((tuple(r) for r in J.op7(spark, SF).collect()), key=str) == brute(rows)


def test_odd_rows_and_empty_table(spark, make):
    assert got(make(ODD_ROWS)) == brute(ODD_ROWS)
    assert got(make([])) == []


def near_copies(seed):
    """Families of texts whose copies differ by more and more words, texts around the threshold, a passage many share."""
    rnd = random.Random(seed)
    word = lambda: "".join(rnd.choice("abcdefgh") for _ in range(4))     # noqa: E731
    passage = [word() for _ in range(60)]
    rows = []
    for _ in range(25):
        base = [word() for _ in range(rnd.choice([3, 5, 6, 8, 12, 20, 40, 90, 200]))]
        if rnd.random() < 0.5:
            base = passage + base
        for _ in range(6):
            copy = list(base)
            for _ in range(rnd.randint(0, max(1, len(copy) // 25))):
                at = rnd.randrange(len(copy))
                copy[at:at + rnd.randint(0, 2)] = [word() for _ in range(rnd.randint(0, 2))]
            rows.append((len(rows), " ".join(copy)))
        rows.append((len(rows), " ".join(base + [word() for _ in range(len(base) // 4)])))
    return rows


@pytest.mark.parametrize("seed", [1, 2])
def test_near_copies(spark, make, seed):
    rows = near_copies(seed)
    assert got(make(rows).repartition(4)) == brute(rows)


def test_flushes_and_leaders(spark, make, monkeypatch):
    """A group of copies larger than the bound on all pairs, met in many small batches."""
    rnd = random.Random(5)
    base = [f"w{k}" for k in range(120)]
    rows = []
    for i in range(150):
        copy = list(base)
        copy[rnd.randrange(120)] = f"x{i}"
        rows.append((i, " ".join(copy)))
    rows += [(1000 + i, " ".join(base[:60] + [f"o{i}_{k}" for k in range(70)])) for i in range(30)]
    monkeypatch.setattr(J, "FLUSH", 500)
    assert got(make(rows).repartition(3)) == brute(rows)


@settings(max_examples=300, deadline=None)
@given(st.integers(1, 400), st.integers(0, 2**32))
def test_linked_sets_share_one_of_their_first_words(n, seed):
    """The pigeonhole bound itself: any order of words that both sides agree on will do."""
    rnd = np.random.default_rng(seed)
    a = np.unique(rnd.integers(0, 1 << 63, n, dtype=np.uint64))
    keep = a[rnd.random(len(a)) > rnd.random() * 0.2]
    b = np.unique(np.concatenate([keep, rnd.integers(0, 1 << 63, rnd.integers(0, n // 4 + 1), dtype=np.uint64)]))
    both = len(np.intersect1d(a, b))
    if len(b) == 0 or 100 * both < 80 * (len(a) + len(b) - both):
        return
    order = lambda words: sorted(words.tolist(), key=lambda w: (w >> 63, w))     # noqa: E731
    one, two = dict(J.bands(len(a))), dict(J.bands(len(b)))
    band = min(len(a), len(b)).bit_length() - 1
    first = set(order(J.sketch(a, band, one[band]))[:one[band] + 1])
    assert first & set(order(J.sketch(b, band, two[band]))[:two[band] + 1])


def test_a_task_gives_its_memory_back_when_its_own_is_freed(monkeypatch):
    held, trimmed = [], []

    class Large:
        pass

    def run(batches):
        large = Large()
        held.append(weakref.ref(large))
        for batch in batches:
            yield batch, bool(large)

    monkeypatch.setattr(tables.ctypes, "CDLL", lambda name: SimpleNamespace(malloc_trim=lambda pad: trimmed.append(held[0]())))
    task = tables.released(run)(iter([1, 2]))
    assert next(task) == (1, True) and not trimmed
    assert list(task) == [(2, True)]
    assert trimmed == [None]
    monkeypatch.setattr(tables.ctypes, "CDLL", lambda name: SimpleNamespace())      # another C library
    assert list(tables.released(run)(iter([3]))) == [(3, True)]


def test_words_do_not_depend_on_slices(monkeypatch):
    texts = pa.array(["a b c d e f " * 40, None, "", "one two", "Ä b C d é f g"] * 30)
    whole = [h.tolist() for h in J.shingle_sets(texts)]
    monkeypatch.setattr(words, "SLICE_BYTES", 64)
    assert [h.tolist() for h in J.shingle_sets(texts)] == whole
