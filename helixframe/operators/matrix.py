"""The multialignment of segments against their consensus, contexts, and the rules that correct each column."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterable
from itertools import groupby

import numpy as np

from .alignment import edit_distance, path

ALPHABET = "ACGTU-N"


def positioned(query_aln: str, target_aln: str) -> list[str]:
    """2t + 1 slots: what the query has before each base of the target, at it, and after the last; '-' for nothing."""
    slots = [""]
    for q, t in zip(query_aln, target_aln, strict=True):
        if t == "-":
            slots[-1] += q
        else:
            slots += [q, ""]
    return [s or "-" for s in slots]


def _offsets(longest: str, inserted: str) -> tuple[int, int]:
    """(matches, offset) of the best ungapped placement; the first of equal ones."""
    best = (0, 0)
    for at in range(len(longest) - len(inserted) + 1):
        n = sum(x == y for x, y in zip(inserted, longest[at:], strict=False))
        if n > best[0]:
            best = (n, at)
    return best


def fit(longest: str, inserted: str) -> str:
    """An insertion spread over the columns of the longest one (padded by a gap on either side).

    In turn: nothing gives gaps; an infix goes where it first stands; an alignment without bases beyond the
    longest is taken over; else the offset with most matches, or flush left.
    """
    width = len(longest)
    if inserted == "-":
        return "-" * width
    at = longest.find(inserted)
    if at >= 0:
        return "-" * at + inserted + "-" * (width - at - len(inserted))
    _, long_aln, own_aln = path(longest, inserted)
    if len(long_aln) == width:
        return own_aln
    at = _offsets(longest, inserted)[1]
    return ("-" * at + inserted).ljust(width, "-")


def multialignment(rows: dict[object, list[str]]) -> dict[object, str]:
    """Rows of slots as rows of equal length, one character a column."""
    columns = [set(slot) for slot in zip(*rows.values(), strict=True)]
    out: dict[object, list[str]] = {key: [] for key in rows}
    for i, found in enumerate(columns):
        size = max(map(len, found))
        if size == 1:
            fitted = {x: x for x in found}
        else:
            longest = "-" + min(x for x in found if len(x) == size) + "-"
            fitted = {x: fit(longest, x) for x in found}
        for key, slots in rows.items():
            out[key].append(fitted[slots[i]])
    return {key: "".join(parts) for key, parts in out.items()}


def frequencies(rows: list[str]) -> list[Counter]:
    """Counts of characters for each column."""
    return [Counter(col) for col in zip(*rows, strict=True)]


def reach(vector: str, half: int) -> int:
    """How far a walk along a gapped vector gets until it meets non-gap half + 1; its last index if it never does."""
    seen = 0
    for at, ch in enumerate(vector):
        seen += ch != "-"
        if seen > half:
            return at
    return max(0, len(vector) - 1)


def context_windows(consensus_row: str, half: int) -> list[tuple[int, int]]:
    """[start, stop) around each column."""
    n, solid, out, before = len(consensus_row), [i for i, ch in enumerate(consensus_row) if ch != "-"], [], 0
    for i, ch in enumerate(consensus_row):
        after = before + (ch != "-")
        start = solid[before - half - 1] + 1 if before > half else min(i, 1)
        out.append((start, solid[after + half] if after + half < len(solid) else max(i + 1, n - 1)))
        before = after
    return out


def _table(rows: list[str]) -> np.ndarray:
    """Characters of rows of equal length as numbers."""
    text = "".join(rows)
    data = np.frombuffer(text.encode(), np.uint8) if text.isascii() else np.frombuffer(text.encode("utf-32-le"), "<u4")
    return data.reshape(len(rows), -1)


def _thin(times: Counter, least: float) -> list[int]:
    """How many columns before each have no character that more than least rows hold: no context across one is more frequent either."""
    table, n = _table(list(times)), np.fromiter(times.values(), np.int64, len(times))
    most = np.zeros(table.shape[1], np.int64)
    for ch in np.unique(table):
        np.maximum(most, n @ (table == ch), out=most)
    return [0, *np.cumsum(most <= least).tolist()]


def frequent_contexts(rows: Iterable[str], windows: list[tuple[int, int]], threshold: float) -> list[list[tuple[str, str, int]]]:
    """For each column (variant, context, depth) of contexts more frequent than noise: deepest first, then by text.

    rows may come counted.
    """
    least, held, out = max(threshold / 10, 5), {}, []
    times = rows if isinstance(rows, Counter) else Counter(rows)
    thin = _thin(times, least) if windows and times and len(set(map(len, times))) == 1 else None
    for i, (start, stop) in enumerate(windows):
        if thin and thin[stop] > thin[start]:
            out.append([])
            continue
        if (start, stop) not in held:
            counts: dict[str, int] = {}
            for r, n in times.items():
                context = r[start:stop]
                counts[context] = counts.get(context, 0) + n
            held[start, stop] = sorted(((c, n) for c, n in counts.items() if n > least), key=lambda x: (-x[1], x[0]))
        out.append([(c[i - start], c, n) for c, n in held[start, stop]])
    return out


def _bare(text: str) -> str:
    return text.replace("-", "")


def _runs(text: str) -> str:
    return "".join(ch for ch, _ in groupby(text))


def alternatives(consensus_row: str, contexts: list[list[tuple[str, str, int]]], windows: list[tuple[int, int]], threshold: float) -> list[list[tuple[str, str, int]]]:
    """Contexts that stand beside the consensus at each column: (variant, context, depth) in order of admission.

    A context whose homopolymer form is on file is passed over. Otherwise it is compared, as it is and in that form, with
    every text on file; it is admitted if its depth reaches the threshold over its least distance, and filed in the form
    that came closest.
    """
    out = []
    for found, (start, stop) in zip(contexts, windows, strict=True):
        admitted: dict[str, tuple[str, str, int] | None] = {}
        if len(found) > 1 and len({v for v, _, _ in found}) > 1:
            plain = _bare(consensus_row[start:stop])
            admitted = {_runs(plain): None, plain: None}
            for variant, context, depth in found:
                text = _bare(context)
                short = _runs(text)
                if short in admitted:
                    continue
                least, form = min(((edit_distance(known, x), 2 * i + j, x) for i, known in enumerate(admitted) for j, x in enumerate((text, short))))[::2]
                if depth >= threshold / max(1.0, least):
                    admitted[form] = (variant, context, depth)
            for key in {_runs(plain), plain}:
                del admitted[key]
        out.append([x for x in admitted.values() if x])
    return out


def corrected_rows(rows: dict[object, str], consensus_row: str, k: int, ratio: float) -> dict[object, str]:
    """Each row's corrected text, without gaps. Equal rows are corrected once, and only where they differ from the consensus."""
    threshold = max(3, len(rows) * ratio)
    windows = context_windows(consensus_row, k // 2)
    times = Counter(rows.values())
    others = alternatives(consensus_row, frequent_contexts(times + Counter([consensus_row]), windows, threshold), windows, threshold)
    known: dict[tuple[str, str], int] = {}
    if not consensus_row:
        return dict.fromkeys(rows, "")
    table, n = _table([consensus_row, *times]), np.array([0, *times.values()])
    # What a row keeps of its own needs a context on file, or a character that is deep enough; elsewhere the consensus stands.
    open_ = np.zeros(table.shape, bool)
    open_[:, [i for i, found in enumerate(others) if found]] = True
    for ch in np.unique(table):
        open_ |= (table == ch) & (n @ (table == ch) >= threshold)
    open_ &= table != table[0]
    differ = {row: np.flatnonzero(places).tolist() for row, places in zip(times, open_[1:], strict=True)}

    def distance(a: str, b: str) -> int:
        if (a, b) not in known:
            known[a, b] = edit_distance(_bare(a), _bare(b))
        return known[a, b]

    def choose(row: str, i: int) -> str:
        start, stop = windows[i]
        ref, own, context = consensus_row[i], row[i], row[start:stop]
        if others[i]:
            # An exact context decides, also over a closer one before it; else the nearest one, the consensus first.
            exact = next((v for v, c, _ in others[i] if c == context), None)
            return exact if exact is not None else min([(distance(consensus_row[start:stop], context), -1, ref), *((distance(c, context), n, v) for n, (v, c, _) in enumerate(others[i]))])[2]
        sides = row[start:i] == consensus_row[start:i] and row[i + 1 : stop] == consensus_row[i + 1 : stop]
        return own if "-" not in (ref, own) and sides else ref

    done = {}
    for row, places in differ.items():
        out = list(consensus_row)
        for i in places:
            out[i] = choose(row, i)
        done[row] = _bare("".join(out))
    return {key: done[row] for key, row in rows.items()}
