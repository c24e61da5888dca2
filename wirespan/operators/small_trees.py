"""Segments of expression trees that fit in a task each: numpy over all trees of a task at once, level by level, both ways. trees.segments deals them out."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Kinds by their numbers in rows; OTHER for any other node, REF for a reference (id, up its node) instead of a node.
KINDS = ("reference", "constant", "expression", "concat", "pattern", "replicate", "convert", "assign")
OTHER, REF = -1, 100
_EXPRESSION, _REPLICATE, _CONVERT, _ASSIGN = (KINDS.index(k) for k in ("expression", "replicate", "convert", "assign"))
#: What a row of the result is: a segment, the width of a root (in win_hi), or a root with too many segments, which are not made.
SEGMENT, ROOT, LEFT = 0, 1, 2
ROWS = "note int, root_id long, ref_id long, net_id long, lo long, hi long, exact int, win_lo long, win_hi long, expression boolean, positional boolean, ordinal long"
_SCHEMA = pa.schema([(n, {"long": pa.int64(), "int": pa.int32(), "boolean": pa.bool_()}[t]) for n, t in (x.split() for x in ROWS.split(", "))])


def segments(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[pa.RecordBatch]:
    """Rows (root, id, up, kind, a, b, c, d, e) of whole trees: of a node ordinal, width and times, of a reference net_id, lo, hi, exact and net_width.
    most: segments that one tree may have, and that are made at once."""
    batches = [x for x in batches if x.num_rows]
    if batches:
        trees = _Trees(pa.Table.from_batches(batches))
        for roots in trees.chunks(most):
            yield from trees.placed(roots)
        yield from trees.roots(most)


def _numbers(column) -> tuple[np.ndarray, np.ndarray]:
    """Values, and whether they are there."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return pc.fill_null(column, 0).to_numpy(zero_copy_only=False).astype(np.int64), pc.is_valid(column).to_numpy(zero_copy_only=False)


def _spread(first: np.ndarray, count: np.ndarray) -> np.ndarray:
    """first, first + 1, ... of each, count long."""
    ends = np.cumsum(count)
    return np.repeat(first - (ends - count), count) + np.arange(ends[-1] if len(ends) else 0)


class _Trees:
    """The nodes in the order of their ids; kids: positions of all operands, by parent and place."""

    def __init__(self, rows: pa.Table):
        kind = _numbers(rows["kind"])[0]
        self.refs = rows.filter(pa.array(kind == REF))
        nodes = rows.filter(pa.array(kind != REF))
        nodes = nodes.take(pa.array(np.argsort(_numbers(nodes["id"])[0], kind="stable")))
        self.id, self.root = _numbers(nodes["id"])[0], _numbers(nodes["root"])[0]
        self.kind = _numbers(nodes["kind"])[0]
        up, inner = _numbers(nodes["up"])
        ordinal = _numbers(nodes["a"])[0]
        self.given, there = _numbers(nodes["b"])
        self.given_known = there & (self.given != 0)
        self.times, self.times_known = _numbers(nodes["c"])
        self.up = np.where(inner, np.searchsorted(self.id, up), -1)
        order = np.lexsort((self.id, ordinal, self.up))
        tops = int((~inner).sum())
        self.kids, self.tops, n = order[tops:], order[:tops], len(order)
        self.n_kids = np.bincount(self.up[self.kids], minlength=n)
        self.first_kid = np.cumsum(self.n_kids) - self.n_kids
        ref_node = np.searchsorted(self.id, _numbers(self.refs["up"])[0])
        by_node = np.lexsort((_numbers(self.refs["id"])[0], ref_node))
        self.refs = self.refs.take(pa.array(by_node))
        self.n_refs = np.bincount(ref_node, minlength=n)
        self.first_ref = np.cumsum(self.n_refs) - self.n_refs
        self.one = np.isin(self.kind, [KINDS.index(k) for k in ("reference", "constant", "expression")])
        self.cut = np.isin(self.kind, [KINDS.index(k) for k in ("concat", "pattern")])
        self.repeats = self.kind == _REPLICATE
        self._count()

    def _count(self) -> None:
        """Upwards: widths, what is before each operand, and how many segments a node comes to: f where it stands in what computes, l where it has no place, o else."""
        levels = [self.tops]
        while len(levels[-1]):
            at = levels[-1]
            levels.append(self.kids[_spread(self.first_kid[at], self.n_kids[at])])
        zeros = lambda t=np.int64: np.zeros(len(self.id), t)
        self.width, self.known, self.has, self.bare, self.off = zeros(), zeros(bool), self.n_refs > 0, zeros(bool), zeros(bool)
        self.elder, self.nth, self.past_f, self.past_l, self.past_e, self.once, self.o = (zeros() for _ in range(7))
        sum_width, unknown, sum_f, sum_l, some = zeros(), zeros(), zeros(), zeros(), zeros(bool)
        for k in reversed(range(len(levels) - 1)):
            x = levels[k]
            kind, all_known = self.kind[x], (self.n_kids[x] > 0) & (unknown[x] == 0)
            summed = self.cut[x] | (kind == _ASSIGN)
            copied = sum_width[x] * self.times[x]
            self.width[x] = width = np.where(summed, sum_width[x], np.where(self.repeats[x], copied, self.given[x]))
            self.known[x] = known = np.where(summed, all_known, np.where(self.repeats[x], all_known & self.times_known[x] & (copied != 0), self.given_known[x]))
            self.has[x] |= some[x]
            one = self.one[x]
            self.bare[x] = bare = one & ~self.has[x]
            own = self.n_refs[x] + bare
            f = self.n_refs[x] + sum_f[x]
            l = own + np.where(one, sum_f[x], sum_l[x])  # noqa: E741
            each = np.where(self.repeats[x], self.once[x] * np.maximum(self.times[x], 0), self.once[x])
            self.o[x] = o = own + np.where(one, sum_f[x], np.where(known, each, sum_l[x]))
            if not k:
                return
            up = self.up[x]
            starts = np.flatnonzero(np.r_[True, up[1:] != up[:-1]])
            group = np.repeat(starts, np.diff(np.r_[starts, len(x)]))

            def before(v, group=group):
                sums = np.cumsum(v) - v
                return sums - sums[group]

            self.elder[x] = before(np.where(known, width, 0))
            self.nth[x] = nth = before(np.ones(len(x), np.int64))
            same = known & self.given_known[up] & (width == self.given[up])
            lacking = (before((~known).astype(np.int64)) > 0) | ~known
            self.off[x] = off = np.where(self.cut[up], lacking, np.where(self.repeats[up], ~known, (self.kind[up] == _CONVERT) & ~same))
            e = np.where(off, l, o)
            self.past_f[x], self.past_l[x], self.past_e[x] = before(f), before(l), before(e)
            walked = (self.kind[up] != _ASSIGN) | (nth == 0)
            parents = up[starts]
            for sums, v in ((sum_width, np.where(known, width, 0)), (unknown, (~known).astype(np.int64)), (sum_f, f * walked), (sum_l, l * walked), (self.once, e * walked)):
                sums[parents] = np.add.reduceat(v, starts)
            some[parents] = np.logical_or.reduceat(self.has[x], starts)

    def chunks(self, most: int) -> Iterator[np.ndarray]:
        """Roots whose segments are made together."""
        small = self.tops[self.o[self.tops] <= most]
        part = np.cumsum(self.o[small]) // most
        for roots in np.split(small, np.flatnonzero(np.diff(part)) + 1):
            if len(roots):
                yield roots

    def roots(self, most: int) -> Iterator[pa.RecordBatch]:
        left = self.tops[self.o[self.tops] > most]
        for note, at in ((ROOT, self.tops), (LEFT, left)):
            yield from _rows({"note": np.full(len(at), note, np.int32), "root_id": self.root[at], "win_hi": pa.array(self.width[at], mask=~self.known[at])}, len(at))

    def placed(self, at: np.ndarray) -> Iterator[pa.RecordBatch]:
        """Downwards, from roots: windows, and the ordinal of the first segment of each node and copy."""
        n, no = len(at), np.zeros(len(at), bool)
        base, lost, frozen, in_lo, in_hi, has_in, start = np.zeros(n, np.int64), no, no, np.zeros(n, np.int64), np.zeros(n, np.int64), no, np.zeros(n, np.int64)
        while len(at):
            width = self.width[at]
            there = np.where(frozen, has_in, self.known[at] & ~lost)
            lo, hi = np.where(frozen, in_lo, base), np.where(frozen, in_hi, base + width - 1)
            yield from self._of_refs(at, there, lo, hi, frozen, start)
            b = np.flatnonzero(self.bare[at] & ~frozen)
            false = np.zeros(len(b), bool)
            yield from _rows({"note": np.zeros(len(b), np.int32), "root_id": self.root[at[b]], "win_lo": pa.array(lo[b], mask=~there[b]), "win_hi": pa.array(hi[b], mask=~there[b]), "expression": false, "positional": false, "ordinal": start[b]}, len(b))
            i = np.repeat(np.arange(len(at)), self.n_kids[at])
            kid = self.kids[_spread(self.first_kid[at], self.n_kids[at])]
            walked = (self.kind[at[i]] != _ASSIGN) | (self.nth[kid] == 0)
            i, kid = i[walked], kid[walked]
            up = at[i]
            n_lost, n_frozen = lost[i] | ~self.known[up], frozen[i] | self.one[up]
            copied = self.repeats[up] & ~n_lost & ~n_frozen & self.known[kid]
            copies = np.where(copied, np.maximum(self.times[up], 0), 1)
            copy = _spread(copied.astype(np.int64), copies)
            i, kid, up, n_lost, n_frozen = (np.repeat(v, copies) for v in (i, kid, up, n_lost, n_frozen))
            n_base = base[i] + np.where(self.cut[up], width[i] - self.elder[kid] - self.width[kid], np.where(self.repeats[up], width[i] - copy * self.width[kid], 0))
            first = start[i] + self.n_refs[up] + (self.bare[up] & ~frozen[i])
            past = np.where(n_frozen, self.past_f[kid], np.where(n_lost, self.past_l[kid], self.past_e[kid] + np.maximum(copy - 1, 0) * self.once[up]))
            in_lo, in_hi, has_in = np.where(frozen[i], in_lo[i], base[i]), np.where(frozen[i], in_hi[i], base[i] + width[i] - 1), np.where(frozen[i], has_in[i], ~n_lost)
            lost = n_lost | self.off[kid]
            at, base, frozen, start = kid, np.where(lost, 0, n_base), n_frozen, first + past

    def _of_refs(self, at, there, lo, hi, frozen, start) -> Iterator[pa.RecordBatch]:
        i = np.repeat(np.arange(len(at)), self.n_refs[at])
        k = _spread(self.first_ref[at], self.n_refs[at])
        node, refs = at[i], self.refs.take(pa.array(k))
        expression = frozen[i] | (self.kind[node] == _EXPRESSION)
        (r_lo, has_lo), (r_hi, has_hi), (net_width, has_width), (exact, _) = (_numbers(refs[c]) for c in "bced")
        ends = has_lo & has_hi
        positional = ~expression & (self.n_refs[node] == 1) & (exact == 1) & there[i] & (ends | has_width) & (np.where(ends, r_hi - r_lo + 1, net_width) == self.width[node])
        yield from _rows({
            "note": np.zeros(len(i), np.int32), "root_id": self.root[node], "ref_id": refs["id"], "net_id": refs["a"], "lo": refs["b"], "hi": refs["c"], "exact": refs["d"], "win_lo": pa.array(lo[i], mask=~there[i]),
            "win_hi": pa.array(hi[i], mask=~there[i]), "expression": expression, "positional": positional, "ordinal": start[i] + k - self.first_ref[node]}, len(i))


def _rows(columns: dict, n: int) -> Iterator[pa.RecordBatch]:
    if n:
        made = [columns[f.name] if f.name in columns else pa.nulls(n, f.type) for f in _SCHEMA]
        made = [pa.chunked_array([x]) if isinstance(x, pa.Array) else x if isinstance(x, pa.ChunkedArray) else pa.chunked_array([pa.array(x)]) for x in made]
        yield from pa.table(made, names=_SCHEMA.names).cast(_SCHEMA).to_batches(max_chunksize=65536)
