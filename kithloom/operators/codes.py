"""Numbers in place of the names of a membership network: what is moved and kept between steps is then a fraction as large."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, functions as F

from kithloom.operators.order import numbered
from kithloom.operators.skew import lookup_join
from kithloom.session import keep


@dataclass(frozen=True)
class Codes:
    """(community, ci) and (vertex, vi), numbers from 1 in the order of the names; ``links`` has the numbers under the names' columns."""

    communities: DataFrame
    vertices: DataFrame
    links: DataFrame

    def encode(self, df: DataFrame) -> DataFrame:
        """df with numbers for its communities and vertices, which must be among those of the links."""
        return self._swapped(df, "community", "vertex", "ci", "vi")

    def decode(self, df: DataFrame) -> DataFrame:
        """df with names for numbers."""
        return self._swapped(df, "ci", "vi", "community", "vertex")

    def decode_communities(self, df: DataFrame) -> DataFrame:
        """df (community, ...), without vertices, with names for its communities' numbers."""
        named = lookup_join(df.withColumnRenamed("community", "ci"), self.communities, ["ci"])
        return named.select(*df.columns)

    def _swapped(self, df: DataFrame, community: str, vertex: str, to_community: str, to_vertex: str) -> DataFrame:
        rows = df.withColumnsRenamed({"community": community, "vertex": vertex}).join(self.vertices, vertex)
        new = {"community": F.col(to_community).alias("community"), "vertex": F.col(to_vertex).alias("vertex")}
        return lookup_join(rows, self.communities, [community]).select(*(new.get(c, F.col(c)) for c in df.columns))


def coded(m: DataFrame) -> Codes:
    """The numbers of a membership network; ``m`` is read several times, so it should be a kept table."""
    communities = numbered(m.select("community").distinct(), ["community"], "ci")
    vertices = numbered(m.select("vertex").distinct(), ["vertex"], "vi")
    return Codes(communities, vertices, keep(Codes(communities, vertices, m).encode(m), "links"))
