"""Kernels against brute force and hand cases."""

import random
from itertools import combinations

import pytest

from helixframe.operators import alignment, batches, seeds
from helixframe.operators import alignment as A
from helixframe.operators import correction as C
from helixframe.operators import matrix as M
from helixframe.operators.seeds import iterate_pairs, minimizers
from helixframe.plans.params import Params


def naive(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j - 1] + (x != y), row[j] + 1, new[-1] + 1))
        row = new
    return row[-1]


def dna(r, n):
    return "".join(r.choice("ACGT") for _ in range(n))


def test_distances_and_paths_against_the_plain_table():
    r = random.Random(5)
    for _ in range(600):
        a, b = dna(r, r.randint(0, 15)), dna(r, r.randint(0, 15))
        assert A.edit_distance(a, b) == naive(a, b)
        assert A.edit_distance(a, b, 3) == (naive(a, b) if naive(a, b) <= 3 else -1)
        d, q, t = A.path(a, b)
        assert d == naive(a, b) and q.replace("-", "") == a and t.replace("-", "") == b
        assert A.infix_distance(a, b) == min(naive(a, b[i:j]) for i in range(len(b) + 1) for j in range(i, len(b) + 1))


def test_path_prefers_insertion_going_back():
    assert A.path("AA", "A")[1:] == ("AA", "A-")


def test_semi_global_hand_cases():
    assert A.semi_global("ACGTACGT", "TTTACGTACGTTTT") == (32, "---ACGTACGT---", "TTTACGTACGTTTT")
    assert A.semi_global("ACGTACGT", "ACGACGT")[0] == 16
    assert A.semi_global("", "AC") == (0, "--", "AC")


@pytest.mark.parametrize(
    ("seq", "k", "w", "want"),
    [("ACGTACGT" * 3, 9, 20, [("ACGTACGTA", 8)]), ("ACG", 9, 20, [("", 11)]), ("CCCCG", 2, 3, [("CC", 1)])],
)
def test_minimizers_hand_cases(seq, k, w, want):
    assert minimizers(seq, k, w) == want


def test_minimizers_ties_go_last_and_the_final_kmer_is_not_seen():
    assert minimizers("AAAAAAAAAAAA", 3, 5)[0] == ("AAA", 2)
    assert minimizers("TTTAACCCGGG", 3, 5)[0] == ("TAA", 2)
    assert 10 not in [p for _, p in minimizers("TTTTTTTTTTAAA", 3, 5)]


def test_pairs_are_half_open_and_reversed():
    assert list(iterate_pairs([("a", 0), ("b", 18), ("c", 19), ("d", 80), ("e", 81)], 18, 80))[0] == ("a", 0, [("d", 80), ("c", 19)])


def test_schedule_is_optimal():
    assert C.schedule([(0, 10, 2), (10, 20, 2), (20, 30, 2)]) == [0, 1, 2]
    r = random.Random(2)
    for _ in range(300):
        items = sorted(((s, s + r.randint(1, 9), r.randint(1, 5)) for s in (r.randint(0, 20) for _ in range(r.randint(1, 8)))), key=lambda x: (x[1], x[0]))
        weight = lambda chosen, items=items: sum((items[i][2] - 1) * (items[i][1] - items[i][0] + 0.0001) for i in chosen)
        fits = lambda c, items=items: all(items[x][1] <= items[y][0] for x, y in zip(c, c[1:], strict=False))
        best = max(weight(c) for n in range(len(items) + 1) for c in combinations(range(len(items)), n) if fits(c))
        got = C.schedule(items)
        assert fits(got) and weight(got) == pytest.approx(best)


def test_contexts_edges():
    assert [M.reach(x, k) for x, k in (("ACGT", 2), ("A-C-G-T", 2), ("AC", 9), ("", 3))] == [2, 4, 1, 0]
    assert M.context_windows("ACGTACGTACGT", 2) == [(0, 3), (1, 4), (1, 5), (1, 6), (2, 7), (3, 8), (4, 9), (5, 10), (6, 11), (7, 11), (8, 11), (9, 12)]


def test_multialignment_rows_are_equally_long_and_lossless():
    r = random.Random(3)
    for _ in range(100):
        center = dna(r, 12)
        rows, texts = {"c": M.positioned(center, center)}, {"c": center}
        for n in range(5):
            text = "".join(x + (dna(r, 2) if r.random() < 0.1 else "") for x in center if r.random() > 0.1)
            _, q, t = A.path(text, center)
            rows[n], texts[n] = M.positioned(q, t), text
        out = M.multialignment(rows)
        assert len({len(x) for x in out.values()}) == 1
        assert {k: v.replace("-", "") for k, v in out.items()} == texts


def test_insertions_fit():
    assert M.fit("-GACG-", "-") == "------"
    assert M.fit("-GACG-", "AC") == "--AC--"
    assert M.fit("-GACG-", "AG").replace("-", "") == "AG"


def test_consensus_cases():
    assert A.consensus([]) == ""
    assert A.consensus(["ACGTACGT"]) == "ACGTACGT"
    assert A.consensus(["ACGTACGT"] * 4) == "ACGTACGT"
    assert A.consensus(["ACGTTCGTAC", "ACGTACGTAC", "ACGTACGTAC", "ACGTACGGTAC"]) == "ACGTACGTAC"


def test_guard_runs():
    ten, eleven = "A" * 10, "A" * 11
    assert C.guarded("C" + "-" * 10 + "C", "C" + ten + "C") == "C" + ten + "C"
    assert C.guarded("C" + "-" * 11 + "C", "C" + eleven + "C") == "CC"
    assert C.guarded("C" + "A" * 6 + "-" * 6 + "C", "C" + "-" * 6 + "G" * 6 + "C") == "CAAAAAAC"


def test_stitch():
    assert C.stitch("AAAACCCCGGGG", [(2, 4, "TT"), (6, 8, "")]) == "AATTCCGGGG"


def noisy_cluster(seed=11, reads=30, error=0.05):
    r = random.Random(seed)
    true = dna(r, 200)
    out = []
    for _ in range(reads):
        s = []
        for ch in true:
            x = r.random()
            if x < error / 3:
                continue
            s.append(r.choice("ACGT") if x < 2 * error / 3 else ch)
            if x > 1 - error / 3:
                s.append(r.choice("ACGT"))
        out.append("".join(s))
    return true, out


@pytest.mark.parametrize("exact", [True, False])
def test_correction_lowers_error(exact):
    true, reads = noisy_cluster()
    fixed = dict(C.correct_batch(list(range(1, 31)), reads, ["5" * len(s) for s in reads], Params(), exact))
    before, after = (sum(naive(x, true) for x in xs) for xs in (reads, fixed.values()))
    assert after < 0.4 * before


def test_reads_without_quality_and_short_reads_are_corrected():
    assert dict(C.correct_batch([1, 2], ["ACGT", ""], [None, ""], Params(), False)) == {1: "ACGT", 2: ""}


def test_params():
    with pytest.raises(ValueError):
        Params(k=21, w=20)
    assert Params(xmin=3).low == 18
    assert Params(dynamic_window=True).for_batch(30).w == 11
    assert Params(dynamic_window=True).for_batch(400).w == 17


def _pairs(r, count, longest, letters="ACGT"):
    first, second = [], []
    for _ in range(count):
        a = "".join(r.choice(letters) for _ in range(r.choice([0, 1, r.randint(0, longest)])))
        b = "".join(ch for x in a for ch in (x * r.choice([1, 1, 1, 1, 0, 2]) if r.random() < 0.9 else r.choice(letters))) if r.random() < 0.8 else "".join(r.choice(letters) for _ in range(r.randint(0, longest)))
        first.append(a)
        second.append(b)
    return first, second


@pytest.mark.parametrize("longest", [5, 70, 200])
def test_batches_equal_single_pairs(longest):
    r = random.Random(longest)
    first, second = _pairs(r, 150, longest)
    assert batches.paths(first, second) == [alignment.path(a, b) for a, b in zip(first, second)]
    for settings in ((), (2, -2, 2, 1), (4, -8, 12, 1, False), (5, -4, 3, 3, False)):
        assert batches.semi_globals(first, second, *settings) == [alignment.semi_global(a, b, *settings) for a, b in zip(first, second)]
    assert batches.infix_distances(first, second) == [alignment.infix_distance(a, b) for a, b in zip(first, second)]


def test_batches_are_cut_by_memory(monkeypatch):
    first, second = _pairs(random.Random(1), 60, 90, "AC")
    monkeypatch.setattr(batches, "BLOCK_BYTES", 3000)
    assert batches.paths(first, second) == [alignment.path(a, b) for a, b in zip(first, second)]
    assert batches.semi_globals(first, second) == [alignment.semi_global(a, b) for a, b in zip(first, second)]
    assert batches.paths([], []) == [] and batches.infix_distances([], []) == []


@pytest.mark.parametrize("letters", ["ACGT", "AC", "A", "ACGTUN-", "ACGx"])
def test_minimizer_places_equal_the_state_machine(letters):
    r = random.Random(letters)
    for _ in range(300):
        k = r.randint(1, 11)
        w = k + r.randint(0, 14)
        seq = "".join(r.choice(letters) for _ in range(r.choice([0, 1, k, w, w + 1, w + 2, 40, 300])))
        assert seeds.minimizer_places(seq, k, w) == [p for _, p in seeds.minimizers(seq, k, w)]


def test_first_minimizers_by_rescanning_each_window():
    r = random.Random(2)
    for largest in (False, True):
        for _ in range(200):
            k, seq = r.randint(1, 4), "".join(r.choice("AC") for _ in range(r.randint(0, 60)))
            w = k + r.randint(0, 8)
            got = seeds.first_minimizers(seq, k, w, largest)
            expected, best = [], None
            for start in range(max(1, len(seq) - k - (w - k))):
                window = [seq[i : i + k] for i in range(start, start + w - k + 1)]
                new = (max if largest else min)(window)
                left = start and seq[start - 1 : start - 1 + k] == best
                if best is None or left or new != best:
                    expected.append((new, start + window.index(new)))
                best = new
            assert got == expected


def test_column_rules_look_only_where_something_can_stay(monkeypatch):
    """Contexts are counted where every column has a character of enough rows, so the work isn't columns times rows of text."""
    r, seen = random.Random(9), []
    rows = {i: dna(r, 400) for i in range(1, 9)}

    class Counted(str):
        def __getitem__(self, at):
            seen.append(at)
            return str.__getitem__(self, at)

    M.frequent_contexts([Counted(x) for x in rows.values()], M.context_windows(dna(r, 400), 4), 3)
    assert len(seen) < 400
    center = dna(r, 400)
    assert M.corrected_rows(rows, center, 9, 0.9) == dict.fromkeys(rows, center)
