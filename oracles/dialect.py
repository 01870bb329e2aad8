"""SQL text for DuckDB: its spellings of the text functions, and stages of expressions as a chain of CTEs."""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pagemill.functions.dialect import Dialect


class DuckDialect(Dialect):
    name = "duckdb"

    def s(self, v: str) -> str:
        return "'" + v.replace("'", "''") + "'"

    def pat(self, p: str) -> str:
        # RE2 has no possessive quantifiers (and needs none: it never backtracks)
        p = re.sub(r"(?<!\\)([*+?}])\+", r"\1", p)
        p = p.replace("(?dm)", "(?m)")
        return self.s(p)

    def rx_replace(self, x: str, p: str, rep: str) -> str:
        rep = re.sub(r"\$(\d)", r"\\\1", rep)
        return f"regexp_replace({x}, {self.pat(p)}, {self.s(rep)}, 'g')"

    def rx_extract(self, x: str, p: str, g: int = 1) -> str:
        return f"regexp_extract({x}, {self.pat(p)}, {g})"

    def rx_extract_all(self, x: str, p: str) -> str:
        return f"regexp_extract_all({x}, {self.pat(p)})"

    def rlike(self, x: str, p: str) -> str:
        return f"regexp_matches({x}, {self.pat(p)})"

    def rx_count(self, x: str, p: str) -> str:
        return f"len({self.rx_extract_all(x, p)})"

    def before(self, x: str, sep: str) -> str:
        return f"split_part({x}, {self.s(sep)}, 1)"

    def split(self, x: str, sep: str) -> str:
        return f"string_split({x}, {self.s(sep)})"

    def fold_text(self, arr: str, acc: str, v: str, body: str) -> str:
        return f"list_reduce(list_prepend('', {arr}), lambda {acc}, {v}: {body})"

    def transform(self, arr: str, v: str, body: str) -> str:
        return f"list_transform({arr}, lambda {v}: {body})"

    def filter(self, arr: str, v: str, body: str) -> str:
        return f"list_filter({arr}, lambda {v}: {body})"

    def size(self, arr: str) -> str:
        return f"len({arr})"

    def array_join(self, arr: str, sep: str) -> str:
        return f"array_to_string({arr}, {self.s(sep)})"

    def elem(self, arr: str, i: int) -> str:
        return f"({arr})[{i}]"

    def array_max(self, arr: str) -> str:
        return f"list_max({arr})"

    def map_get(self, m: str, k: str) -> str:
        return f"({m})[{k}]"

    def map_lit(self, d: dict) -> str:
        return "MAP {" + ", ".join(f"{self.s(k)}: {self.s(v)}" for k, v in d.items()) + "}"

    def listagg(self, x: str, order: str) -> str:
        return f"string_agg({x}, '' ORDER BY {order})"

    def last_nn(self, x: str) -> str:
        return f"last_value({x} IGNORE NULLS)"

    def first_nn(self, x: str) -> str:
        return f"first_value({x} IGNORE NULLS)"

    def cp2str(self, v: str) -> str:
        return f"chr(CAST({v} AS INTEGER))"

    def hex2int(self, x: str) -> str:
        return f"CAST(('0x' || {x}) AS BIGINT)"

    def startswith(self, x: str, p: str) -> str:
        return f"starts_with({x}, {self.s(p)})"

    def utf8_hex(self, ch: str) -> str:
        return f"hex(encode({ch}))"

    def min_by(self, x: str, y: str) -> str:
        return f"arg_min_null({x}, {y})"

    def struct(self, pairs) -> str:
        return "{" + ", ".join(f"'{k}': {v}" for k, v in pairs) + "}"

    def trim(self, x: str, chars: str) -> str:
        return f"trim({x}, {self.s(chars)})"


DUCK = DuckDialect()


@dataclass
class Sel:
    """SELECT <keep or *>, expr AS alias, ... (expressions may not reference each other)."""
    cols: list
    keep: list | None = None


@dataclass
class Where:
    cond: str


@dataclass
class Explode:
    """SELECT keep, posexplode(arr) AS (pos, val)."""
    arr: str
    pos: str
    val: str
    keep: list


@dataclass
class Agg:
    keys: list
    cols: list = field(default_factory=list)


def duck_ctes(stages, source: str, prefix: str) -> tuple[list[str], str]:
    """Render stages as DuckDB CTEs; returns (cte definitions, name of the last CTE)."""
    ctes, prev = [], source
    for i, st in enumerate(stages):
        name = f"{prefix}{i}"
        if isinstance(st, Sel):
            head = ", ".join(st.keep) if st.keep is not None else "*"
            cols = "".join(f", {sql} AS {a}" for a, sql in st.cols)
            ctes.append(f"{name} AS (SELECT {head}{cols} FROM {prev})")
        elif isinstance(st, Where):
            ctes.append(f"{name} AS (SELECT * FROM {prev} WHERE {st.cond})")
        elif isinstance(st, Explode):
            keep = ", ".join(st.keep)
            ctes.append(f"{name} AS (SELECT {keep}, unnest({st.arr}) AS {st.val}, "
                        f"generate_subscripts({st.arr}, 1) - 1 AS {st.pos} FROM {prev})")
        elif isinstance(st, Agg):
            keys = ", ".join(st.keys)
            cols = "".join(f", {sql} AS {a}" for a, sql in st.cols)
            ctes.append(f"{name} AS (SELECT {keys}{cols} FROM {prev} GROUP BY {keys})")
        prev = name
    return ctes, prev


def run_w(part: str, order: str) -> str:
    return f"OVER (PARTITION BY {part} ORDER BY {order} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"


def prev_w(part: str, order: str) -> str:
    return f"OVER (PARTITION BY {part} ORDER BY {order} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"


def all_w(part: str) -> str:
    return f"OVER (PARTITION BY {part})"
