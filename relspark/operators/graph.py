"""Graphs of concepts, edges and properties of either, asked by joins on what is known."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


@dataclass
class Graph:
    """concepts: (curie, key, value); edges: (eid, subject, object); properties: (eid, key, value), of edges.

    Filters on properties come first, edges are met by the known concepts and then by their own properties; sizes are left
    to Catalyst."""

    concepts: DataFrame
    edges: DataFrame
    properties: DataFrame

    def concept_properties(self, curies: DataFrame) -> DataFrame:
        """(curie, key, value) of the concepts given in a column curie."""
        return self.concepts.join(curies.select("curie").distinct(), "curie", "left_semi")

    def having(self, key: str, values: list[str]) -> DataFrame:
        """(curie): concepts with one of these values."""
        return self.concepts.filter((F.col("key") == key) & F.col("value").isin(values)).select("curie").distinct()

    def edge_property_values(self, key: str) -> DataFrame:
        """(value): all values of an edge property."""
        return self.properties.filter(F.col("key") == key).select("value").distinct()

    def edges_having(self, wanted: dict[str, list[str]], of: DataFrame | None = None) -> DataFrame:
        """(eid, subject, object): edges, or those of some, that have, for each key, one of the values."""
        out = self.edges if of is None else of
        for key, values in wanted.items():
            own = self.properties.filter((F.col("key") == key) & F.col("value").isin(values)).select("eid")
            out = out.join(own, "eid", "left_semi")
        return out

    def known_to_x(self, known: DataFrame, edge: dict[str, list[str]] | None = None) -> DataFrame:
        """(eid, subject, object) from the known concepts on."""
        near = self.edges.join(known.select(F.col("curie").alias("subject")), "subject", "left_semi")
        return self.edges_having(edge or {}, near).select("eid", "subject", "object")

    def x_to_known(self, known: DataFrame, edge: dict[str, list[str]] | None = None) -> DataFrame:
        """(eid, subject, object) that lead to the known concepts."""
        near = self.edges.join(known.select(F.col("curie").alias("object")), "object", "left_semi")
        return self.edges_having(edge or {}, near).select("eid", "subject", "object")

    def known_to_known(self, left: DataFrame, right: DataFrame, edge: dict[str, list[str]] | None = None) -> DataFrame:
        """(a, m, b): what an edge from a concept of left and one from a concept of right both lead to."""
        a = self.known_to_x(left, edge).select(F.col("subject").alias("a"), F.col("object").alias("m")).distinct()
        b = self.known_to_x(right, edge).select(F.col("subject").alias("b"), F.col("object").alias("m")).distinct()
        return a.join(b, "m").select("a", "m", "b")

    def with_properties(self, rows: DataFrame, column: str, into: dict[str, str]) -> DataFrame:
        """rows with a property of the concept in a column, for each key of into by its name; those without it go."""
        for key, name in into.items():
            own = self.concepts.filter(F.col("key") == key).select(F.col("curie").alias(column), F.col("value").alias(name))
            rows = rows.join(own, column)
        return rows
