"""Column functions on charts: the named type from what a plot is made of, styles by name, paths in records."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Names of chart types by how values are grouped.
GROUPED = {
    "area": {"standard": "AREA", "stacked": "AREA_STACKED", "percentStacked": "AREA_STACKED_100"},
    "area3D": {"standard": "THREE_D_AREA", "stacked": "THREE_D_AREA_STACKED", "percentStacked": "THREE_D_AREA_STACKED_100"},
    "bar": {"clustered": "BAR_CLUSTERED", "stacked": "BAR_STACKED", "percentStacked": "BAR_STACKED_100"},
    "column": {"clustered": "COLUMN_CLUSTERED", "stacked": "COLUMN_STACKED", "percentStacked": "COLUMN_STACKED_100"},
    "line": {"standard": "LINE", "stacked": "LINE_STACKED", "percentStacked": "LINE_STACKED_100"},
    "line with markers": {"standard": "LINE_MARKERS", "stacked": "LINE_MARKERS_STACKED", "percentStacked": "LINE_MARKERS_STACKED_100"},
}


def chart_type(plot: Column, grouping: Column, bars: Column, markers: Column, exploded: Column, style: Column, lines: Column, deep: Column) -> Column:
    """The type of a plot (area, area3D, bar, line, pie, doughnut, radar, scatter, bubble); null for one that has none.

    bars says whether bars lie; markers, exploded, lines and deep (3D bubbles) are flags; style is that of radars and scatters.
    """
    kind = F.when((plot == "bar") & ~bars, "column").when((plot == "line") & markers, "line with markers").otherwise(plot)
    out = F.lit(None).cast("string")
    for name, by_grouping in GROUPED.items():
        for value, named in by_grouping.items():
            out = F.when((kind == name) & (grouping == value), named).otherwise(out)
    smooth = style == "smoothMarker"
    scatter = F.when((style == "lineMarker") & ~lines, "XY_SCATTER").when((style == "lineMarker") & markers, "XY_SCATTER_LINES").when(style == "lineMarker", "XY_SCATTER_LINES_NO_MARKERS")
    scatter = scatter.when(smooth & markers, "XY_SCATTER_SMOOTH").when(smooth, "XY_SCATTER_SMOOTH_NO_MARKERS").otherwise("XY_SCATTER")
    return (
        F.when(plot == "pie", F.when(exploded, "PIE_EXPLODED").otherwise("PIE"))
        .when(plot == "doughnut", F.when(exploded, "DOUGHNUT_EXPLODED").otherwise("DOUGHNUT"))
        .when(plot == "bubble", F.when(deep, "BUBBLE_THREE_D_EFFECT").otherwise("BUBBLE"))
        .when(plot == "radar", F.when(style == "filled", "RADAR_FILLED").when(markers & style.isNotNull(), "RADAR_MARKERS").otherwise("RADAR"))
        .when(plot == "scatter", scatter)
        .otherwise(out)
    )


def same_style(name: Column, wanted: Column) -> Column:
    """Whether two names of a style agree, whatever their case, hyphens and blanks."""
    plain = lambda c: F.upper(F.regexp_replace(c, r"[-\s_]", ""))
    return plain(name) == plain(wanted)


def with_path(record: Column, path: str, value: Column) -> Column:
    """A struct with a nested field set, by dotted path."""
    return record.withField(path, value)
