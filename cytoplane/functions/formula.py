"""Model formulas: `~ a + b + a:b`, `0 +` or `- 1` without an intercept, back-quoted names, `a*b`, and functions of
columns such as `log2(a)` or `I(a^2)`."""

from __future__ import annotations

import ast
import re

import numpy as np
import pandas as pd


FUNCTIONS = {"log": np.log, "log2": np.log2, "log10": np.log10, "log1p": np.log1p, "exp": np.exp, "sqrt": np.sqrt, "abs": np.abs, "I": lambda x: x}
_CALL = re.compile(rf"\b(?:{'|'.join(FUNCTIONS)})\s*\(")


def _calls(formula: str) -> list[str]:
    """The calls of functions in a formula that stand in no other call."""
    out, at = [], 0
    while m := _CALL.search(formula, at):
        depth, at = 1, m.end()
        while depth:
            if at >= len(formula):
                raise ValueError(f"no closing parenthesis: {formula}")
            depth += {"(": 1, ")": -1}.get(formula[at], 0)
            at += 1
        out.append(formula[m.start() : at])
    return out


def evaluate(call: str, table: pd.DataFrame) -> np.ndarray:
    """A call of FUNCTIONS on numeric columns; within it + - * / ^ and parentheses have their usual meaning."""
    ops = {ast.Add: np.add, ast.Sub: np.subtract, ast.Mult: np.multiply, ast.Div: np.divide, ast.Pow: np.power}

    def value(node):
        if isinstance(node, ast.Call) and isinstance(node.func, ast.Name) and node.func.id in FUNCTIONS and len(node.args) == 1:
            return FUNCTIONS[node.func.id](value(node.args[0]))
        if isinstance(node, ast.BinOp) and type(node.op) in ops:
            return ops[type(node.op)](value(node.left), value(node.right))
        if isinstance(node, ast.UnaryOp) and isinstance(node.op, ast.USub):
            return -value(node.operand)
        if isinstance(node, ast.Constant) and isinstance(node.value, (int, float)):
            return float(node.value)
        if isinstance(node, ast.Name):
            return table[node.id].to_numpy(float)
        raise ValueError(f"can't read {call!r}")

    with np.errstate(all="ignore"):
        got = value(ast.parse(call.replace("^", "**"), mode="eval").body)
    if not np.isfinite(got).all():
        raise ValueError(f"{call} is not finite everywhere")
    return got


def variables(formula: str) -> list[str]:
    """The columns in a formula, each once, in order."""
    found = re.findall(r"`([^`]+)`|([A-Za-z_.][A-Za-z0-9_.]*)\b(?!\s*\()", formula)
    return list(dict.fromkeys(a or b for a, b in found))


def terms(formula: str) -> tuple[bool, list[tuple[str, ...]]]:
    """Whether there is an intercept, and the terms as tuples of names, lower orders first."""
    right = formula.strip().removeprefix("~")
    quoted: list[str] = []
    for call in dict.fromkeys(_calls(right)):
        right = right.replace(call, f"`{call}`")
    right = re.sub(r"`([^`]+)`", lambda m: quoted.append(m[1]) or f"\x00{len(quoted) - 1}\x00", right)
    name = lambda s: re.sub("\x00(\\d+)\x00", lambda m: quoted[int(m[1])], s.strip())
    intercept, out = True, []
    for sign, part in re.findall(r"([+-]?)\s*([^+-]+)", right):
        part = part.strip()
        if part in ("0", "1"):
            intercept = (part == "1") == (sign != "-")
        elif sign == "-":
            gone = frozenset(map(name, part.split(":")))
            out = [t for t in out if frozenset(t) != gone]
        elif "*" in part:
            names = [name(p) for p in part.split("*")]
            for k in range(1, 1 << len(names)):
                out.append(tuple(n for i, n in enumerate(names) if k >> i & 1))
        else:
            out.append(tuple(name(p) for p in part.split(":")))
    unique = {frozenset(t): t for t in reversed(out)}
    return intercept, sorted(reversed(unique.values()), key=len)


def polynomial_contrasts(n: int) -> np.ndarray:
    """Orthogonal polynomials over n equally spaced levels, columns of length one."""
    q, r = np.linalg.qr(np.vander(np.arange(n) - (n - 1) / 2, n, increasing=True))
    return (q * np.sign(np.diag(r)))[:, 1:]


def design_matrix(formula: str, table: pd.DataFrame, categorical: tuple[str, ...] = (), ordinal: tuple[str, ...] = (), levels: dict[str, list] | None = None) -> pd.DataFrame:
    """Columns as a linear model wants them: numbers as they are; text, booleans and `categorical` by treatment
    contrasts against the first level (all levels of the first such term without an intercept); `ordinal` by orthogonal
    polynomials. Levels are those given for a column, in their order, else its values, sorted. Columns that are zero throughout go. Nulls raise ValueError, and so do as many columns as rows."""
    intercept, parts = terms(formula)
    lacking = [v for v in variables(formula) if v not in table.columns]
    if lacking:
        raise ValueError(f"not in the table: {', '.join(lacking)}")
    used = table[variables(formula)]
    if used.isna().any().any():
        raise ValueError("the variables of a formula must not be null")
    coded_full = not intercept

    def coded(v: str, full: bool) -> dict[str, np.ndarray]:
        if v not in table.columns:
            return {v: evaluate(v, table)}
        x = table[v]
        factor = v in categorical or v in ordinal or v in (levels or {}) or x.dtype == bool or not pd.api.types.is_numeric_dtype(x)
        if not factor:
            return {v: x.to_numpy(float)}
        known = (levels or {}).get(v) or sorted(x.unique())
        if v in ordinal:
            c = polynomial_contrasts(len(known))
            suffix = [".L", ".Q", ".C"]
            rows = c[[known.index(i) for i in x]]
            return {v + (suffix[k] if k < 3 else f"^{k + 1}"): rows[:, k] for k in range(c.shape[1])}
        return {f"{v}{n}": (x == n).to_numpy(float) for n in (known if full else known[1:])}

    out: dict[str, np.ndarray] = {"(Intercept)": np.ones(len(table))} if intercept else {}
    for term in parts:
        columns: dict[str, np.ndarray] = {}
        for v in term:
            full = coded_full and len(term) == 1 and v in table.columns and (v in categorical or v in (levels or {}) or table[v].dtype == bool or not pd.api.types.is_numeric_dtype(table[v]))
            one = coded(v, full)
            if full:
                coded_full = False
            columns = {f"{a}:{b}": x * y for b, y in one.items() for a, x in columns.items()} if columns else one
        out |= columns
    design = pd.DataFrame({k: v for k, v in out.items() if np.any(v)}, index=table.index)
    if len(design) <= design.shape[1]:
        raise ValueError(f"{design.shape[1]} coefficients need more than {len(design)} samples")
    return design
