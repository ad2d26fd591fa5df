"""Rewrites that Catalyst can't do, as they need the shapes of matrices: on the expression graph, before lowering.

* two transposes cancel; a transpose goes through element-wise operators, and into products as flags of the join
* a constant factor goes from a product's operand to its result or to its smaller side
* a chain of products is associated anew where that needs fewer multiplications
* a subarray goes through transposes, element-wise operators and products down to the cells
"""

from __future__ import annotations

from tessera.plans.matrix import MUL, Matrix


def rewrite(node: Matrix) -> Matrix:
    done: dict[int, Matrix] = {}

    def walk(x: Matrix) -> Matrix:
        if id(x) not in done:
            fresh = x if not x.operands else _same(x, tuple(walk(o) for o in x.operands))
            done[id(x)] = _local(fresh)
        return done[id(x)]

    while True:
        done.clear()
        after = _associate(walk(node))
        if after is node:
            return node
        node = after


def _same(x: Matrix, operands: tuple[Matrix, ...]) -> Matrix:
    return x if all(a is b for a, b in zip(x.operands, operands, strict=True)) else Matrix(x.op, x.meta, operands, x.params)


def _local(x: Matrix) -> Matrix:
    if x.op == "transpose":
        (a,) = x.operands
        if a.op == "transpose":
            return a.operands[0]
        if a.op == "elementwise" and all(o.op == "transpose" for o in a.operands):
            return Matrix("elementwise", x.meta, tuple(o.operands[0] for o in a.operands), a.params)
        if a.op == "matmul" and any(o.op == "transpose" for o in a.operands):
            left, right = a.operands
            return right.T @ left.T
    if x.op == "subarray":
        return _push_subarray(x)
    if x.op == "matmul":
        left, right = x.operands
        for side in (left, right):
            if side.op == "constant" and side.params["op"] == MUL and side.operands[0].meta.size > x.meta.size and side.meta.dtype == side.operands[0].meta.dtype:
                inner = side.operands[0]
                product = (inner if side is left else left) @ (inner if side is right else right)
                return Matrix("constant", x.meta, (product,), side.params)
    return x


def _push_subarray(x: Matrix) -> Matrix:
    (a,), rows, cols = x.operands, x.params["rows"], x.params["cols"]
    if a.op == "transpose":
        return a.operands[0].subarray(cols, rows).T
    if a.op in ("elementwise", "constant", "densify", "sparsify") or (a.op == "map" and a.params):
        return Matrix(a.op, x.meta, tuple(o.subarray(rows, cols) for o in a.operands), a.params)
    if a.op == "matmul":
        left, right = a.operands
        if rows != (0, left.meta.rows - 1) or cols != (0, right.meta.cols - 1):
            whole = (0, left.meta.cols - 1)
            return left.subarray(rows, whole) @ right.subarray(whole, cols)
        return a
    if a.op == "subarray":
        (r0, _), (c0, _) = a.params["rows"], a.params["cols"]
        return a.operands[0].subarray((rows[0] + r0, rows[1] + r0), (cols[0] + c0, cols[1] + c0))
    if rows == (0, a.meta.rows - 1) and cols == (0, a.meta.cols - 1):
        return a
    return x


def _chain(x: Matrix, uses: dict[int, int]) -> list[Matrix]:
    """The factors of a product, through products that nothing else uses."""
    out = []
    for o in x.operands:
        out += _chain(o, uses) if o.op == "matmul" and uses[id(o)] == 1 else [o]
    return out


def _cost(x: Matrix, inside: set[int]) -> int:
    if id(x) not in inside:
        return 0
    left, right = x.operands
    return left.meta.rows * left.meta.cols * right.meta.cols + _cost(left, inside) + _cost(right, inside)


def _associate(root: Matrix) -> Matrix:
    uses: dict[int, int] = {}
    seen: set[int] = set()

    def count(x: Matrix) -> None:
        for o in x.operands:
            uses[id(o)] = uses.get(id(o), 0) + 1
            if id(o) not in seen:
                seen.add(id(o))
                count(o)

    count(root)
    done: dict[int, Matrix] = {}

    def walk(x: Matrix) -> Matrix:
        if id(x) in done:
            return done[id(x)]
        if x.op == "matmul" and len(factors := _chain(x, uses)) > 2:
            inside: set[int] = set()

            def mark(y: Matrix) -> None:
                inside.add(id(y))
                for o in y.operands:
                    if o.op == "matmul" and uses[id(o)] == 1:
                        mark(o)

            mark(x)
            best = best_order([f.meta.shape for f in factors])
            if best[0] < _cost(x, inside):
                new = [walk(f) for f in factors]

                def build(plan) -> Matrix:
                    return new[plan] if isinstance(plan, int) else build(plan[0]) @ build(plan[1])

                done[id(x)] = build(best[1])
                return done[id(x)]
        done[id(x)] = _same(x, tuple(walk(o) for o in x.operands))
        return done[id(x)]

    return walk(root)


def best_order(shapes: list[tuple[int, int]]) -> tuple[int, object]:
    """The least number of multiplications of a chain, and the nesting of factor numbers that needs it."""
    n = len(shapes)
    best: dict[tuple[int, int], tuple[int, object]] = {(k, k): (0, k) for k in range(n)}
    for size in range(2, n + 1):
        for a in range(n - size + 1):
            b = a + size - 1
            best[a, b] = min(
                ((best[a, m][0] + best[m + 1, b][0] + shapes[a][0] * shapes[m][1] * shapes[b][1], (best[a, m][1], best[m + 1, b][1])) for m in range(a, b)),
                key=lambda x: x[0],
            )
    return best[0, n - 1]
