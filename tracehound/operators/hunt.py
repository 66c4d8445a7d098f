"""Interactive questions over the tables of a case: artifact_rows, findings, timeline and process trees."""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracehound.sources.canonical import row_text

from .ordered import neighbourhood
from .retrieval import frequency_class
from .text_index import TextIndex


@dataclass
class Hunt:
    rows: DataFrame
    findings: DataFrame | None = None
    timeline: DataFrame | None = None
    trees: DataFrame | None = None
    index: TextIndex | None = None

    def indexed(self, path: str | None = None, blocks: int = 256) -> Hunt:
        """This hunt with an index over the rows' texts, which searches and frequencies then go by."""
        return replace(self, index=TextIndex.build(self.rows, row_text(F.col("row")), path, blocks))

    def artifacts(self) -> DataFrame:
        """(artifact, n), the largest first."""
        return self.rows.groupBy("artifact").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "artifact")

    def holding(self, text: str) -> DataFrame:
        """All rows that hold a text, by the index if there is one."""
        return self.index.search(text) if self.index else self.rows.filter(F.contains(F.lower(row_text(F.col("row"))), F.lit(text.lower())))

    def search(self, text: str, most: int | None = 20) -> DataFrame:
        """Rows that hold a text; the scan ends when enough are found. All of them if most is None."""
        found = self.holding(text)
        return found if most is None else found.limit(most)

    def slice(self, artifact: str, start: int = 0, count: int | None = 50) -> DataFrame:
        """Rows start to start + count - 1 of an artifact, to its last if count is None."""
        place = F.col("row_index") >= start if count is None else F.col("row_index").between(start, start + count - 1)
        return self.rows.filter((F.col("artifact") == artifact) & place).orderBy("row_index")

    def similar_artifacts(self, part: str) -> DataFrame:
        return self.rows.select("artifact").distinct().filter(F.contains(F.lower("artifact"), F.lit(part.lower())))

    def find(self, severity: str | None = None, category: str | None = None, most: int | None = 20) -> DataFrame:
        out = self.findings
        if severity:
            out = out.filter(F.lower("severity") == severity.lower())
        if category:
            out = out.filter(F.contains(F.lower("category"), F.lit(category.lower())))
        return out if most is None else out.limit(most)

    def finding(self, id_: str) -> DataFrame:
        return self.findings.filter(F.col("id") == id_)

    def tree(self, leaf: str | None = None, most: int | None = 15) -> DataFrame:
        if leaf is not None:
            return self.trees.filter(F.col("leaf") == leaf)
        return self.trees if most is None else self.trees.limit(most)

    def around(self, text: str, events: int = 10) -> DataFrame:
        """The timeline around the first event whose description holds a text."""
        return neighbourhood(self.timeline, "time", "row_index", F.contains(F.lower("description"), F.lit(text.lower())), events // 2)

    def frequency(self, value: str) -> DataFrame:
        """(n, artifacts, class) of the rows that hold a value."""
        held = self.holding(value).agg(F.count("*").alias("n"), F.sort_array(F.collect_set("artifact")).alias("artifacts"))
        return held.withColumn("class", frequency_class(F.col("n")))


def unclaimed(rows: DataFrame, claimed: DataFrame) -> DataFrame:
    """Artifacts that no detector or normaliser took."""
    return rows.select("artifact").distinct().join(claimed.select("artifact").distinct(), "artifact", "left_anti")
