"""Spellings of Spark SQL functions that the SQL text of ``functions.sqltext`` is made of (one JVM parse
per expression, instead of thousands of py4j calls)."""

from __future__ import annotations


class Dialect:
    name = "spark"

    # literals ------------------------------------------------------------
    def s(self, v: str) -> str:
        return "'" + v.replace("\\", "\\\\").replace("'", "\\'") + "'"

    def pat(self, p: str) -> str:
        return self.s(p)

    def trim(self, x: str, chars: str) -> str:
        """``x`` without the given characters at both ends."""
        return f"btrim({x}, {self.s(chars)})"

    # regex ---------------------------------------------------------------
    def rx_replace(self, x: str, p: str, rep: str) -> str:
        return f"regexp_replace({x}, {self.pat(p)}, {self.s(rep)})"

    def rx_extract(self, x: str, p: str, g: int = 1) -> str:
        return f"regexp_extract({x}, {self.pat(p)}, {g})"

    def rx_extract_all(self, x: str, p: str) -> str:
        return f"regexp_extract_all({x}, {self.pat(p)}, 0)"

    def rlike(self, x: str, p: str) -> str:
        return f"({x} RLIKE {self.pat(p)})"

    def rx_count(self, x: str, p: str) -> str:
        return f"regexp_count({x}, {self.pat(p)})"

    def before(self, x: str, sep: str) -> str:
        """The part of ``x`` before the first ``sep``."""
        return f"substring_index({x}, {self.s(sep)}, 1)"

    def split(self, x: str, sep: str) -> str:
        return f"split({x}, {self.s(sep)}, -1)"

    def fold_text(self, arr: str, acc: str, v: str, body: str) -> str:
        """Folds an array of strings into one string, from ''."""
        return f"aggregate({arr}, '', ({acc}, {v}) -> {body})"

    # arrays / lambdas ------------------------------------------------------
    def transform(self, arr: str, v: str, body: str) -> str:
        return f"transform({arr}, {v} -> {body})"

    def filter(self, arr: str, v: str, body: str) -> str:
        return f"filter({arr}, {v} -> {body})"

    def size(self, arr: str) -> str:
        return f"size({arr})"

    def array_join(self, arr: str, sep: str) -> str:
        return f"array_join({arr}, {self.s(sep)})"

    def elem(self, arr: str, i: int) -> str:
        return f"try_element_at({arr}, {i})"

    def array_max(self, arr: str) -> str:
        return f"array_max({arr})"

    def map_get(self, m: str, k: str) -> str:
        return f"try_element_at({m}, {k})"

    def map_lit(self, d: dict) -> str:
        return "map(" + ", ".join(f"{self.s(k)}, {self.s(v)}" for k, v in d.items()) + ")"

    # aggregates / windows ------------------------------------------------------
    def listagg(self, x: str, order: str) -> str:
        return f"listagg({x}, '') WITHIN GROUP (ORDER BY {order})"

    def last_nn(self, x: str) -> str:
        return f"last({x}, true)"

    def first_nn(self, x: str) -> str:
        return f"first({x}, true)"

    # scalars ---------------------------------------------------------------
    def cp2str(self, v: str) -> str:
        return f"decode(unhex(lpad(hex({v}), 8, '0')), 'UTF-32')"

    def hex2int(self, x: str) -> str:
        return f"cast(conv({x}, 16, 10) as bigint)"

    def startswith(self, x: str, p: str) -> str:
        return f"startswith({x}, {self.s(p)})"

    def utf8_hex(self, ch: str) -> str:
        return f"hex(encode({ch}, 'UTF-8'))"

    def bool_or(self, x: str) -> str:
        return f"bool_or({x})"

    def struct(self, pairs) -> str:
        return "named_struct(" + ", ".join(f"'{k}', {v}" for k, v in pairs) + ")"

    def min_by(self, x: str, y: str) -> str:
        """Value of x at the smallest y (x may be NULL there; rows with NULL y are skipped)."""
        return f"min_by({x}, {y})"


SPARK = Dialect()
