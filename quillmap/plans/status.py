"""A short status report per project."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillmap import fixed_values as fx
from quillmap.functions.text import trim
from quillmap.sources.documents import first_filled_lines


def _block(title: str, content: Column) -> Column:
    inner = trim(content)
    return F.when(inner != "", F.concat(F.lit(f"{title}\n"), inner, F.lit("\n")))


def status_reports(documents: DataFrame, drift: DataFrame) -> DataFrame:
    """``repo, text`` for projects with a state or handoff document."""

    def of(doc: str) -> DataFrame:
        rows = documents.filter(F.col("doc") == doc)
        return rows.select("repo", F.col("front").alias(f"{doc}_front"), F.col("body").alias(f"{doc}_body"))

    def meta(key: str) -> Column:
        return F.coalesce(F.try_element_at(F.col("state_front"), F.lit(key)), F.lit("?"))

    state = F.when(
        F.col("state_body").isNotNull(),
        F.concat(
            F.lit("updated "), meta("updated"), F.lit(" · lastAgent "), meta("lastAgent"),
            F.lit(" · phase "), meta("phase"), F.lit("\n"), F.col("state_body"),
        ),
    )
    handoff = first_filled_lines(F.col("handoff_body"), fx.HANDOFF_PREVIEW_LINES)
    changed = F.coalesce(F.col("changed"), F.lit(-1))
    message = (
        F.when(changed == -1, "no index yet")
        .when(changed == 0, "up to date")
        .otherwise(F.concat(changed.cast("string"), F.lit(" file(s) changed since last index")))
    )
    joined = of("state").join(of("handoff"), "repo", "full").join(drift, "repo", "left")
    text = F.concat_ws(
        "\n", _block("State", state), _block("Last handoff", handoff), _block("Index", message)
    )
    return joined.select("repo", F.concat(text, F.lit("\n")).alias("text"))
