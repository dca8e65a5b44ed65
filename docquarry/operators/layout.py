"""Page layout from regions (invoice_id, region_id, text, x, y, w, h, confidence): rows, zones, neighbours."""

from __future__ import annotations

import functools
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

NUMERIC = r"^[$€£¥]?\s*-?[\d.,]+%?$"


def page(*order: Column | str) -> Window:
    return Window.partitionBy("invoice_id").orderBy(*order)


def rows_by_mean(regions: DataFrame, tolerance: int = 10) -> DataFrame:
    """(invoice_id, row, region_ids): regions in order of centre (y, x); one joins the row before it while its
    centre is within the tolerance of the mean of that row's centres. Row members by x. regions: or pages of them."""
    return cells_by_mean(regions, tolerance).select("invoice_id", "row", F.transform("cells", lambda c: c["id"]).alias("region_ids"))


def cells_by_mean(regions: DataFrame, tolerance: int = 10) -> DataFrame:
    """(invoice_id, row, cells): ``rows_by_mean`` with the regions themselves (x, id, text, confidence).

    The mean moves with each member, so this is a fold over one page's sorted regions; it keeps where each row begins. A
    region beyond the tolerance of the one before it is beyond that of the mean too, and a run of others whose ends are within
    the tolerance is one row: pages of such runs need no fold."""
    cy = lambda c: F.floor(c["y"] + c["h"] / 2).cast("long")
    members = F.sort_array(F.transform("cells", lambda c: F.struct(cy(c).alias("cy"), c["x"].cast("long").alias("x"), c["region_id"].cast("long").alias("id"), c["text"].alias("text"), c["confidence"].alias("confidence"))))
    start = F.expr("named_struct('starts', cast(array() as array<int>), 'sum', 0L, 'n', 0L, 'i', 1)")

    def step(s: Column, cy: Column) -> Column:
        near = (s["n"] > 0) & (F.abs(cy - s["sum"] / s["n"]) <= tolerance)
        same = F.struct(s["starts"].alias("starts"), (s["sum"] + cy).alias("sum"), (s["n"] + 1).alias("n"), (s["i"] + 1).alias("i"))
        new = F.struct(F.concat(s["starts"], F.array(s["i"])).alias("starts"), cy.alias("sum"), F.lit(1).cast("long").alias("n"), (s["i"] + 1).alias("i"))
        return F.when(near, same).otherwise(new)

    df = pages(regions).select("invoice_id", members.alias("__m"))
    df = df.withColumn("__cy", F.col("__m")["cy"])
    apart = lambda c, i: F.coalesce(c - F.get(F.col("__cy"), i - 1) > tolerance, F.lit(True))
    df = df.withColumn("__s", F.filter(F.transform("__cy", lambda c, i: F.when(apart(c, i), i + 1)), lambda i: i.isNotNull()))
    ends = F.concat(F.slice("__s", 2, F.size("__m")), F.array(F.size("__m") + 1))
    spread = lambda a, b: F.coalesce(F.get(F.col("__cy"), b - 2) - F.get(F.col("__cy"), a - 1) <= tolerance, b - a == 1)
    wide = F.exists(F.zip_with("__s", ends, spread), lambda ok: ~ok)
    df = df.withColumn("__s", F.when(wide, F.aggregate("__cy", start, step, lambda s: s["starts"])).otherwise(F.col("__s")))
    rows = df.select("invoice_id", "__m", F.posexplode(F.arrays_zip(F.col("__s").alias("a"), ends.alias("b"))).alias("row", "__at")).where("__at.a IS NOT NULL")
    rows = rows.select("invoice_id", "row", F.slice("__m", F.col("__at.a"), F.col("__at.b") - F.col("__at.a")).alias("__m"))
    own = F.arrays_zip(*(F.col("__m")[c].alias(c) for c in ("x", "id", "text", "confidence")))
    return rows.select("invoice_id", "row", F.sort_array(own).alias("cells"))


def rows_by_gap(regions: DataFrame, gap: int = 12) -> DataFrame:
    """Regions with text and their row: a new one starts where y is at least the gap away from the one before."""
    order = page("y", "region_id")
    text = regions.where(F.trim("text") != "")
    new = F.coalesce((F.abs(F.col("y") - F.lag("y").over(order)) >= gap).cast("int"), F.lit(0))
    return text.withColumn("__new", new).withColumn("row", F.sum("__new").over(order)).drop("__new")


def cut(cells: str, new: Callable[[Column, Column], Column]) -> Column:
    """An array column as the runs of its elements; a run begins where ``new`` holds of an element and the one before it."""
    starts = F.filter(F.transform(cells, lambda c, i: F.when((i == 0) | new(c, F.get(F.col(cells), i - 1)), i + 1)), lambda i: i.isNotNull())
    ends = F.concat(F.slice(starts, 2, F.size(cells)), F.array(F.size(cells) + 1))
    return F.transform(F.arrays_zip(starts.alias("a"), ends.alias("b")), lambda r: F.slice(cells, r["a"], r["b"] - r["a"]))


def cells_by_gap(regions: DataFrame, gap: int = 12) -> DataFrame:
    """(invoice_id, row, cells): ``rows_by_gap`` with the regions of each row, made in the row of their page. regions: or
    pages of them."""
    # regions at one height are in one row in whatever order they stand
    df = pages(regions).select("invoice_id", F.explode(F.array(F.filter("cells", lambda c: F.trim(c["text"]) != ""))).alias("cells"))
    rows = df.where(F.size("cells") > 0).select("invoice_id", F.posexplode(cut("cells", lambda c, p: F.abs(c["y"] - p["y"]) >= gap)).alias("row", "cells"))
    return rows.withColumn("row", F.col("row").cast("long"))


def rows_by_bucket(regions: DataFrame, step: int = 10) -> DataFrame:
    """Row as the centre rounded half to even to whole steps."""
    return regions.withColumn("row", bucket_of(step))


def reading_order(regions: DataFrame) -> DataFrame:
    return regions.withColumn("place", F.row_number().over(page("y", "x", "region_id")))


def zones(regions: DataFrame, head: float = 0.3, foot: float = 0.7) -> DataFrame:
    """header, table or footer by the share of the page height (lowest edge of its regions)."""
    height = F.max(F.col("y") + F.col("h")).over(Window.partitionBy("invoice_id"))
    zone = F.when(F.col("y") < F.col("__h") * head, "header").when(F.col("y") > F.col("__h") * foot, "footer").otherwise("table")
    return regions.withColumn("__h", height).withColumn("zone", zone).drop("__h")


#: Distance of centres below which two boxes are near, and how many numeric ones count; fixed values.
NEAR, FIRST_NUMBERS = 50.0, 10
#: Words of each part of a page; fixed values.
CLIENT_WORDS, TAX_WORDS = "invoice|bill to|client|customer|date|due", "tax|vat|gst|discount|subtotal"


def pages(regions: DataFrame) -> DataFrame:
    """(invoice_id, cells): the regions of a page as one array in reading order, so that what concerns a page
    happens within its row. The only exchange of the operators below is this one; pages that come as such (with
    ``cells`` of y, x, region_id, text, w, h, confidence in this order) are taken as they are."""
    if "cells" in regions.columns:
        return regions
    sure = F.col("confidence") if "confidence" in regions.columns else F.lit(1.0)
    return regions.groupBy("invoice_id").agg(F.sort_array(F.collect_list(F.struct("y", "x", "region_id", "text", "w", "h", sure.alias("confidence")))).alias("cells"))


def centre(c: Column | dict[str, Column]) -> tuple[Column, Column]:
    return c["x"] + c["w"] / 2, c["y"] + c["h"] / 2


def numbers_of(cells: Column | str) -> Column:
    """The numeric cells of a page."""
    return F.filter(cells, lambda c: c["text"].rlike(NUMERIC))


def beside(x: Column, y: Column, numbers: Column, distance: float = NEAR) -> Column:
    """Whether a centre is nearer than the distance to that of one of the cells."""

    def near(n: Column) -> Column:
        nx, ny = centre(n)
        return (x - nx) * (x - nx) + (y - ny) * (y - ny) < distance * distance

    return F.exists(numbers, near)


def spots_of(numbers: Column, distance: float = NEAR) -> Column:
    """(band, x, y): the centres of cells by bands somewhat higher than the distance, so that what is near a place lies in its
    band or one beside it."""
    x, y = (lambda n: centre(n)[0].cast("double")), (lambda n: centre(n)[1].cast("double"))
    return F.sort_array(F.transform(numbers, lambda n: F.struct(band_of(y(n), distance).alias("band"), x(n).alias("x"), y(n).alias("y"))))


def band_of(y: Column, distance: float = NEAR) -> Column:
    return F.floor(y / (distance + 1))


def beside_any(x: Column, y: Column, spots: Column, bands: Column, distance: float = NEAR) -> Column:
    """``beside`` for ``spots_of`` by bands: runs of them and the band of each."""
    near = lambda n: (F.abs(y - n["y"]) < distance) & ((x - n["x"]) * (x - n["x"]) + (y - n["y"]) * (y - n["y"]) < distance * distance)
    own, over, under = (F.exists(F.get(spots, (F.array_position(bands, band_of(y, distance) + k) - 1).cast("int")), near) for k in (0, -1, 1))
    return own | over | under


def has_word(text: str, words: str) -> Column:
    """Whether a text holds one of the words, parted by bars."""
    return functools.reduce(Column.__or__, (F.contains(text, F.lit(w)) for w in words.split("|")))


def quadrants(regions: DataFrame, first: int | None = FIRST_NUMBERS) -> DataFrame:
    """vendor, client, line_items, tax or totals, by place and keyword; each region takes the first that fits. Line items
    stand between the highest and the lowest number of the page and near one of its ``first`` numbers (None: of all of them); a
    total with its number in one region counts as totals if nothing else fits. regions: or pages of them."""
    most = lambda cells, f: F.array_max(F.transform(cells, f))
    df = pages(regions).select("invoice_id", "cells", numbers_of("cells").alias("__n"), most("cells", lambda c: c["x"] + c["w"]).alias("__w"), most("cells", lambda c: c["y"] + c["h"]).alias("__h"))
    compared = F.col("__n") if first is None else F.slice("__n", 1, first)
    df = df.select("invoice_id", "__w", "__h", F.array_min(F.col("__n")["y"]).alias("__top"), most("__n", lambda c: c["y"] + c["h"]).alias("__low"), spots_of(compared).alias("__n"), "cells")
    # by runs of one band each, so that a region looks at three bands of its page, however many numbers that holds
    df = df.withColumn("__n", F.when(F.size("__n") > 0, cut("__n", lambda n, p: ~n["band"].eqNullSafe(p["band"]))))
    df = df.select("invoice_id", "__w", "__h", "__top", "__low", "__n", F.transform("__n", lambda r: r[0]["band"]).alias("__bands"), F.inline("cells"))
    x, y = (v.cast("double").alias(n) for n, v in zip(("cx", "cy"), centre(own_cell()), strict=True))
    df = df.select("*", x, y, F.lower("text").alias("__t"))
    near = beside_any(F.col("cx"), F.col("cy"), F.col("__n"), F.col("__bands"))
    part = (
        F.when((F.col("cx") < F.col("__w") * 0.5) & (F.col("cy") < F.col("__h") * 0.3), "vendor").when((F.col("cx") > F.col("__w") * 0.5) | has_word("__t", CLIENT_WORDS), "client")
        .when(F.when(F.col("cy").between(F.col("__top"), F.col("__low")), near), "line_items").when(has_word("__t", TAX_WORDS), "tax").when((F.col("cx") > F.col("__w") * 0.6) & (F.col("cy") > F.col("__h") * 0.7) | F.contains("__t", F.lit("total")), "totals")
    )
    return df.select("invoice_id", "region_id", "text", "x", "y", "w", "h", "confidence", part.alias("part"))


def extents(regions: DataFrame, *by: str) -> DataFrame:
    """The box around the regions of each group."""
    return regions.groupBy(*by).agg(F.min("x").alias("x1"), F.min("y").alias("y1"), F.max(F.col("x") + F.col("w")).alias("x2"), F.max(F.col("y") + F.col("h")).alias("y2"), F.count("*").alias("n"))


def thirds(lines: DataFrame) -> DataFrame:
    """header: the first floor(n / 3) lines of a receipt; footer: from line floor(0.8 n); middle between."""
    whole = Window.partitionBy("invoice_id")
    df = lines.withColumn("__n", F.count("*").over(whole)).withColumn("__i", F.row_number().over(whole.orderBy("line_no")) - 1)
    part = F.when(F.col("__i") < F.floor(F.col("__n") / 3), "header").when(F.col("__i") >= F.floor(F.col("__n") * 8 / 10), "footer").otherwise("middle")
    return df.withColumn("part", part).drop("__n", "__i")


def section(lines: DataFrame, start: str, stop: str, most: int = 20) -> DataFrame:
    """Lines after the first that matches ``start``, up to the first blank one or match of ``stop``."""
    whole = Window.partitionBy("invoice_id")
    df = lines.withColumn("__s", F.min(F.when(F.lower("text").rlike(start), F.col("line_no"))).over(whole)).where(F.col("line_no") > F.col("__s"))
    df = df.withColumn("__e", F.min(F.when((F.trim("text") == "") | F.lower("text").rlike(stop), F.col("line_no"))).over(whole))
    return df.where((F.col("line_no") <= F.col("__s") + most) & (F.col("line_no") < F.coalesce("__e", F.col("line_no") + 1))).drop("__s", "__e")


def overlap(a: str, b: str) -> Column:
    """Intersection over union of boxes (x1, y1, x2, y2) with prefixes a and b."""
    c = lambda p, n: F.col(f"{p}{n}")
    w = F.greatest(F.least(c(a, "x2"), c(b, "x2")) - F.greatest(c(a, "x1"), c(b, "x1")), F.lit(0))
    h = F.greatest(F.least(c(a, "y2"), c(b, "y2")) - F.greatest(c(a, "y1"), c(b, "y1")), F.lit(0))
    area = lambda p: (c(p, "x2") - c(p, "x1")) * (c(p, "y2") - c(p, "y1"))
    union = area(a) + area(b) - w * h
    return F.when(union > 0, w * h / union).otherwise(F.lit(0.0))


def own_cell() -> dict[str, Column]:
    """A region as a row of its own, where the others are elements of an array."""
    return {c: F.col(c) for c in ("x", "y", "w", "h")}


def common(c: Column | dict[str, Column], box: Column | dict[str, Column]) -> Column:
    """The area that a cell (x, y, w, h) and a box (x1, y1, x2, y2) have in common."""
    w = F.greatest(F.least(c["x"] + c["w"], box["x2"]) - F.greatest(c["x"], box["x1"]), F.lit(0))
    h = F.greatest(F.least(c["y"] + c["h"], box["y2"]) - F.greatest(c["y"], box["y1"]), F.lit(0))
    return w * h


def area_of(box: Column | dict[str, Column]) -> Column:
    return (box["x2"] - box["x1"]) * (box["y2"] - box["y1"])


def share_by(both: Column, one: Column, other: Column) -> Column:
    """Intersection over union by the area in common and those of either."""
    union = one + other - both
    return F.when(union > 0, both / union).otherwise(F.lit(0.0))


def share_of(c: Column | dict[str, Column], box: Column | dict[str, Column]) -> Column:
    """Intersection over union of a cell (x, y, w, h) and a box (x1, y1, x2, y2)."""
    return share_by(common(c, box), c["w"] * c["h"], area_of(box))


def apart(c: Column | dict[str, Column], box: Column) -> Column:
    """Whether a cell and a box have no area in common, as far as comparisons of their edges tell: their share is 0."""
    return (c["y"] + c["h"] <= box["y1"]) | (c["y"] >= box["y2"]) | (c["x"] + c["w"] <= box["x1"]) | (c["x"] >= box["x2"])


def best_box(c: Column | dict[str, Column], boxes: Column, least: float) -> Column:
    """(box, iou) that a cell overlaps most, over the least share; the first of equals; box is NULL where there is none."""
    start = F.struct(F.lit(None).cast("string").alias("box"), F.lit(float(least)).alias("iou"))

    def better(best: Column, b: Column) -> Column:
        share = F.when(apart(c, b), 0.0).otherwise(share_of(c, b))
        return F.when(share > best["iou"], F.struct(b["box"].alias("box"), share.alias("iou"))).otherwise(best)

    return F.aggregate(boxes, start, better)


def assign(tokens: DataFrame, boxes: DataFrame, least: float = 0.1) -> DataFrame:
    """(invoice_id, region_id, box, iou): each token with the box of its page it overlaps most, over the least share; the
    first box of equals. Both sides are arrays of their page: pages meet once, by an equi-join, and the overlap is a
    fold inside the row. tokens: regions; boxes: invoice_id, box, x1..y2."""
    held = boxes.groupBy("invoice_id").agg(F.sort_array(F.collect_list(F.struct("box", "x1", "y1", "x2", "y2"))).alias("boxes"))
    return assigned(pages(tokens).join(held, "invoice_id"), least)


def assigned(df: DataFrame, least: float = 0.1) -> DataFrame:
    """``assign`` of pages that hold their boxes already: as an array (cells, boxes), or as a column for each of ``ZONES``
    (see ``zoned_pages``), whose shares are columns of compiled code."""
    if "boxes" not in df.columns:
        most = shares_of_zones(df).withColumn("iou", F.greatest(F.lit(float(least)), *ZONES))
        first = F.coalesce(*(F.when(F.col(z) == F.col("iou"), z) for z in ZONES))
        found = F.when(F.col("iou") > least, F.struct(first.alias("box"), F.col("iou").alias("iou")))
        return most.select("invoice_id", "region_id", F.inline(F.array(found))).where("box IS NOT NULL")
    rows = df.select("invoice_id", "boxes", F.inline("cells"))
    # generated, so that the fold runs once and not again for the filter
    return rows.select("invoice_id", "region_id", F.inline(F.array(best_box(own_cell(), F.col("boxes"), least)))).where("box IS NOT NULL")


def shares_of_zones(df: DataFrame) -> DataFrame:
    """(invoice_id, region_id, footer, header, table): the share of each region in the box of each zone of its page; NULL
    for a zone that is not there. df: see ``zoned_pages``."""
    edges = ("x1", "y1", "x2", "y2")
    box = {z: {e: F.col(f"__{z}_{e}") for e in (*edges, "area")} for z in ZONES}
    rows = df.select("invoice_id", *(F.col(z)[e].alias(f"__{z}_{e}") for z in ZONES for e in edges), *(area_of(F.col(z)).alias(f"__{z}_area") for z in ZONES), *(F.col(z).isNotNull().alias(f"__{z}") for z in ZONES), "cells")
    rows = rows.select(*(c for c in rows.columns if c != "cells"), F.inline("cells"))
    # by steps, each small enough for the compiler of the machine
    rows = rows.withColumns({f"__{z}_both": common(own_cell(), box[z]) for z in ZONES})
    share = lambda z: share_by(F.col(f"__{z}_both"), F.col("w") * F.col("h"), box[z]["area"]).cast("double")
    return rows.select("invoice_id", "region_id", *(F.when(F.col(f"__{z}"), share(z)).alias(z) for z in ZONES))


def box_around(cells: Column | str, name: Column) -> Column:
    """(box, x1, y1, x2, y2) around an array of cells."""
    all_of = F.col(cells) if isinstance(cells, str) else cells
    most = lambda f: F.array_max(F.transform(cells, f))
    return F.struct(name.alias("box"), F.array_min(all_of["x"]).alias("x1"), F.array_min(all_of["y"]).alias("y1"), most(lambda c: c["x"] + c["w"]).alias("x2"), most(lambda c: c["y"] + c["h"]).alias("y2"))


def bucket_of(step: int = 10) -> Column:
    """The row of a region: its centre, rounded half to even to whole steps."""
    return bucket_by(own_cell(), step)


def bucket_by(c: Column | dict[str, Column], step: int = 10) -> Column:
    """``bucket_of`` a cell. rint is the rounding half to even of doubles; bround writes each as a decimal first."""
    return (F.rint((c["y"] + c["h"] / 2) / step) * step).cast("int")


#: Zones of a page by name.
ZONES = ("footer", "header", "table")


def zone_of(c: Column | dict[str, Column], top: Column, low: Column) -> Column:
    """Zone of a cell by the height that the header ends at and the one that the footer begins at."""
    return F.when(c["y"] < top, "header").when(c["y"] > low, "footer").otherwise("table")


def zoned_pages(regions: DataFrame, head: float = 0.3, foot: float = 0.7) -> DataFrame:
    """Pages with their height and, for each of ``ZONES``, the box around what it holds (NULL if nothing) and its cells
    (``footer_cells``); all within the row of the page. regions: or pages of them."""
    df = pages(regions).select("invoice_id", "cells", F.array_max(F.transform("cells", lambda c: c["y"] + c["h"])).alias("height"))
    # limits as columns, so that they are not found again for each cell
    df = df.select("*", (F.col("height") * head).alias("__top"), (F.col("height") * foot).alias("__low"))
    df = df.select("*", *(F.size(F.filter(F.col("cells")["y"], f)).alias(n) for n, f in (("__a", lambda y: y < F.col("__top")), ("__b", lambda y: y > F.col("__low")))))
    # cells stand by their height, so that a zone is a run of them; unless one has none, which sorts first, or the zones cross
    own = lambda z: F.filter("cells", lambda c: zone_of(c, F.col("__top"), F.col("__low")) == z)
    rest = F.size("cells") - F.col("__a") - F.col("__b")
    run = {"header": (F.lit(1), F.col("__a")), "table": (F.col("__a") + 1, rest), "footer": (F.col("__a") + rest + 1, F.col("__b"))}
    runs = F.get("cells", F.lit(0))["y"].isNotNull() & (F.col("__top") <= F.col("__low"))
    df = df.select("invoice_id", "height", "cells", *(F.when(runs, F.slice("cells", *run[z])).otherwise(own(z)).alias(f"{z}_cells") for z in ZONES))
    return df.select("*", *(F.when(F.size(f"{z}_cells") > 0, box_around(F.col(f"{z}_cells"), F.lit(z))).alias(z) for z in ZONES))


def near_numbers(regions: DataFrame, distance: float = NEAR, first: int = FIRST_NUMBERS) -> DataFrame:
    """Regions whose centre is nearer than the distance to one of their page's first numeric ones. regions: or pages of them."""
    df = pages(regions).select("invoice_id", "cells", numbers_of("cells").alias("__n")).select("invoice_id", F.slice("__n", 1, first).alias("__n"), F.inline("cells"))
    return df.where(beside(*centre(own_cell()), F.col("__n"), distance)).select("invoice_id", "region_id", "text", "x", "y", "w", "h", "confidence")


def fields_by_schema(regions: DataFrame, specs: DataFrame) -> DataFrame:
    """(invoice_id, field, value, confidence): the first region of a field's zone that its pattern finds, with
    group 1 of the pattern. specs: field, zone, pattern; a small table."""
    df = zones(regions).join(specs, "zone").withColumn("value", F.expr("regexp_extract(text, pattern, 1)")).where("value <> ''")
    return df.groupBy("invoice_id", "field").agg(F.min_by("value", "region_id").alias("value"), F.min_by("confidence", "region_id").alias("confidence"))


#: Names of region types in use, and the type each stands for; fixed values.
REGION_TYPES = {
    "text": "text_block", "text_block": "text_block", "table": "table", "line_items": "line_items_table", "line_items_table": "line_items_table", "formula": "formula", "image": "image", "title": "title", "header": "header", "footer": "footer",
    "vendor": "vendor_block", "vendor_block": "vendor_block", "client": "client_block", "client_block": "client_block", "summary": "financial_summary", "financial_summary": "financial_summary",
}


def clear_zones() -> Column:
    """Whether the zones of a page (see ``zoned_pages``) lie one below the other with no height in common."""
    below = lambda a, b: F.coalesce(F.col(a)["y2"] <= F.col(b)["y1"], F.lit(True))
    # a place without height sorts first
    return F.get("cells", F.lit(0))["y"].isNotNull() & below("header", "table") & below("table", "footer") & below("header", "footer")


def semantic_layout(regions: DataFrame, zone: bool = True, least: float = 0.0) -> DataFrame:
    """Per page and region type, from one gathering of the page: number of regions, their text in reading order, tokens
    (region ids) by the box of a type that they overlap most, box and content. The content of a table is its rows (by
    bucket, cells by x, parted by a bar), of anything else its lines as they are. ``zone``: types from the zones of the
    page; otherwise ``regions`` has ``kind``. With zones, regions: or pages of them."""
    names = F.create_map(*(F.lit(x) for kv in REGION_TYPES.items() for x in kv))
    told = lambda c: best_box(c, F.col("boxes"), least)["box"]
    part = lambda box, own, its: F.struct(box.alias("b"), F.coalesce(names[box["box"]], F.lit("text_block")).alias("kind"), own.alias("own"), its.alias("told"))
    if zone:
        df = zoned_pages(regions).withColumns({"boxes": F.array_compact(F.array(*ZONES)), "__clear": F.lit(least >= 0) & clear_zones()})
        # where zones stand clear of one another, a cell with an area is told to its own; else its boxes are compared
        own_told = lambda z: F.filter(f"{z}_cells", lambda c: F.coalesce((c["x"] + c["w"] > c["x"]) & (c["y"] + c["h"] > c["y"]), told(c) == z) if least == 0 else told(c) == z)["region_id"]
        df = df.withColumn("__told", F.when(~F.col("__clear"), F.transform("cells", lambda c: F.struct(c["region_id"].alias("region_id"), told(c).alias("told")))))
        its = lambda z: F.when(F.col("__clear"), own_told(z)).otherwise(F.filter("__told", lambda c: c["told"] == z)["region_id"])
        parts = F.array_compact(F.array(*(F.when(F.col(z).isNotNull(), part(F.col(z), F.col(f"{z}_cells"), its(z))) for z in ZONES)))
    else:
        kind = F.coalesce(names[F.lower("kind")], F.lit("text_block"))
        cell = F.struct("y", "x", "region_id", "text", "w", "h", "confidence", kind.alias("zone"))
        df = regions.groupBy("invoice_id").agg(F.sort_array(F.collect_list(cell)).alias("cells"))
        kinds = F.array_sort(F.array_distinct(F.transform("cells", lambda c: c["zone"])))
        df = df.withColumn("boxes", F.transform(kinds, lambda k: box_around(F.filter("cells", lambda c: c["zone"] == k), k)))
        df = df.withColumn("cells", F.transform("cells", lambda c: F.struct(*(c[n].alias(n) for n in ("y", "x", "region_id", "text", "h", "zone")), told(c).alias("told"))))
        # by steps of their own: what is used twice within a lambda runs twice
        parts = F.transform("boxes", lambda b: part(b, F.filter("cells", lambda c: c["zone"] == b["box"]), F.filter("cells", lambda c: c["told"] == b["box"])["region_id"]))
    df = df.select("invoice_id", F.inline(parts))
    placed = F.sort_array(F.transform("own", lambda c: F.struct(bucket_by(c).alias("bucket"), c["x"].alias("x"), c["region_id"].alias("region_id"), c["text"].alias("text"))))
    df = df.withColumn("rows", F.when(F.col("kind").isin("table", "line_items_table"), placed))

    def parted(c: Column, i: Column) -> Column:
        joint = F.when(i == 0, "").when(F.get(F.col("rows"), i - 1)["bucket"] == c["bucket"], " | ").otherwise("\n")
        return F.concat(joint, c["text"])

    texts = F.col("own")["text"]
    # joined once, not piece by piece; a cell without text leaves a table without content
    table = F.when(~F.exists(texts, lambda t: t.isNull()), F.array_join(F.transform("rows", parted), ""))
    content = F.when(F.col("rows").isNotNull(), table).otherwise(F.array_join(texts, "\n"))
    return df.select(
        "invoice_id", F.col("kind").alias("region_type"), F.size("own").cast("long").alias("n"), F.array_join(texts, " ").alias("text"), "b.x1", "b.y1", "b.x2", "b.y2",
        F.sort_array("told").alias("tokens"), content.alias("content"),
    )
