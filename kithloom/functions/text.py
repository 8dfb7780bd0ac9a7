"""Names and keys as texts."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def edge_key(community: Column, vertex: Column) -> Column:
    """``(community, vertex)`` as one text, for exchange with files that index rows this way."""
    return F.format_string("(%s, %s)", community, vertex)


def parse_edge_key(key: Column, vertex_first: bool = False) -> tuple[Column, Column]:
    """(community, vertex) of such a text: brackets removed, cut at the first ``, ``; a community that holds one can't be told from its vertex."""
    inner = F.substring(key, F.lit(2), F.length(key) - 2)
    parts = F.split(inner, ", ")
    head, rest = parts[0], F.array_join(F.slice(parts, F.lit(2), F.greatest(F.size(parts) - 1, F.lit(0))), ", ")
    return (rest, head) if vertex_first else (head, rest)


def numeric_id(vertex: Column) -> Column:
    """A vertex made of digits alone as a number, null for any other."""
    return F.when(vertex.rlike("^[0-9]+$"), vertex.try_cast("long"))


def padded_name(prefix: str, number: Column, total: Column) -> Column:
    """``prefix`` with the number, zero-padded to one digit more than ``total`` has."""
    width = F.length(total.cast("string")) + 1
    return F.concat(F.lit(prefix), F.lpad(number.cast("string"), width, F.lit("0")))


def setting_name(algorithm: str, inter_p: float, k: tuple[int, int], m: float) -> str:
    """Directory name of an experiment setting."""
    return f"{algorithm}_p{inter_p:.2f}_k[{k[0]},{k[1]}]_m{m:.2f}"
