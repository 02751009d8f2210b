"""The atom selection language, compiled to a Column over the atom table.

    expr := term ("or" term)*      term := factor ("and" factor)*
    factor := "not" factor | "(" expr ")" | all | protein | backbone | sidechain
            | (name | resname | element | chain) value+ | resid range+

Keywords are case-insensitive, an empty string selects all atoms, a range is
``5``, ``10-20``, ``8:10`` or ``3 : 7`` with either bound first.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Residues of proteins, atoms of the backbone.
PROTEIN = "ALA ARG ASN ASP CYS GLN GLU GLY HIS ILE LEU LYS MET PHE PRO SER THR TRP TYR VAL MSE HSD HSE HSP".split()
BACKBONE = "N CA C O OXT".split()

FIELDS = ("name", "resname", "element", "chain")
WORDS = {*FIELDS, "and", "or", "not", "(", ")", "all", "protein", "backbone", "sidechain", "resid"}


class SelectionError(ValueError):
    pass


def _isin(field: str, values: list[str]) -> Column:
    return F.upper(F.col(field)).isin([v.upper() for v in values])


class _Parser:
    def __init__(self, text: str):
        self.text = text
        self.tokens = re.findall(r"[()]|:|[^\s():]+", text)
        self.at = 0

    def peek(self) -> str | None:
        return self.tokens[self.at] if self.at < len(self.tokens) else None

    def word(self) -> str:
        return (self.peek() or "").lower()

    def take(self) -> str:
        if self.peek() is None:
            raise SelectionError(f"selection ends too early: {self.text!r}")
        self.at += 1
        return self.tokens[self.at - 1]

    def parse(self) -> Column:
        if not self.tokens:
            return F.lit(True)
        out = self.either()
        if self.peek() is not None:
            raise SelectionError(f"unexpected {self.peek()!r} in {self.text!r}")
        return out

    def either(self) -> Column:
        out = self.both()
        while self.word() == "or":
            self.take()
            out = out | self.both()
        return out

    def both(self) -> Column:
        out = self.one()
        while self.word() == "and":
            self.take()
            out = out & self.one()
        return out

    def one(self) -> Column:
        token = self.take().lower()
        if token == "not":
            return ~self.one()
        if token == "(":
            out = self.either()
            if self.take() != ")":
                raise SelectionError(f"missing ) in {self.text!r}")
            return out
        if token == "all":
            return F.lit(True)
        if token == "protein":
            return _isin("resname", PROTEIN)
        if token == "backbone":
            return _isin("resname", PROTEIN) & _isin("name", BACKBONE)
        if token == "sidechain":
            return ~_isin("name", BACKBONE) & (F.upper("element") != "H")
        if token in FIELDS:
            return _isin(token, self.values(token))
        if token == "resid":
            return self.ranges()
        raise SelectionError(f"unknown {token!r} in {self.text!r}")

    def values(self, field: str) -> list[str]:
        found = []
        while self.peek() is not None and self.word() not in WORDS:
            found.append(self.take())
        if not found:
            raise SelectionError(f"{field} needs a value in {self.text!r}")
        return found

    def ranges(self) -> Column:
        joined = re.sub(r"\s*:\s*", ":", " ".join(self.values("resid")))
        out = F.lit(False)
        for part in joined.split():
            m = re.fullmatch(r"(-?\d+)(?:[:-](-?\d+))?", part)
            if not m:
                raise SelectionError(f"bad residue range {part!r}")
            low, high = int(m[1]), int(m[2] if m[2] is not None else m[1])
            out = out | F.col("resid").between(min(low, high), max(low, high))
        return out


def select(expression: str | Column | None) -> Column:
    return expression if isinstance(expression, Column) else _Parser(expression or "").parse()


def select_indices(atoms: DataFrame, indices: list[int]) -> DataFrame:
    """position, and the atom's columns, in the order given; repeats stay, and an atom that isn't there is an error."""
    wanted = atoms.sparkSession.createDataFrame([(k, int(i)) for k, i in enumerate(indices)], "position long, wanted long")
    found = wanted.join(atoms, F.col("wanted") == F.col("atom"), "left")
    missing = F.when(F.col("atom").isNull(), F.raise_error(F.concat(F.lit("no atom "), F.col("wanted").cast("string"))).cast("long"))
    return found.withColumn("position", F.coalesce(missing, "position")).drop("wanted")
