"""Values of application documents: kinds of files, captions and their values, and scans within a budget."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import DEFAULT, Settings

#: The form's captions with their item numbers and fields, what else ends a value, instructions, words that
#: belong to a caption, marks of the form, and the types of product. A slash stands for itself, "or", or a space.
CAPTION_TABLE = (
    ("brand name", 6, "brand_name"),
    ("fanciful name", 7, "fanciful_name"),
    ("class / type", None, "class_type"),
    ("alcohol content", None, "alcohol_content"),
    ("net contents", None, "net_contents"),
)
STOP_PHRASES = (
    "part i", "part ii", "part iii", "ttb f 5100.31", "ttb id", "serial #", "status :", "origin :", "vintage :",
    "approval date", "expiration date", "qualifications", "a. certificate", "domestic", "imported",
)
INSTRUCTIONS = ("required", "if any", "if on label")
CAPTION_WORDS = ("description", "designation", "code")
MARK_PHRASES = (
    "ttb f 5100.31", "omb no. 1513-0020", "omb no 1513-0020", "application for and certification / exemption of label",
    "public cola registry", "alcohol and tobacco tax and trade bureau",
)
PRODUCT_PHRASES = {"wine": ("wine", "wines"), "distilled spirits": ("distilled spirits",), "malt beverage": ("malt beverage", "malt beverages")}
TICK_MARGIN = 12.0


def phrase(text: str) -> str:
    """Matcher of a phrase as it may be printed or read: any white space, none beside signs, figures and single letters."""
    out, before = "", ""
    for word in text.split():
        if word == "/":
            out, before = out + r"(?:\s*/\s*|\s+(?:or\s+)?)", ""
            continue
        if before:
            out += r"\s*" if 1 in (len(word), len(before)) or not (word[0].isalpha() and before[-1].isalnum()) else r"\s+"
        inner = word[:-1].replace(".", r"\.?\s*").replace("-", r"[-\s]?")
        out, before = out + inner + (r"\." if word[-1] == "." else word[-1]), word
    return out + (r"\b" if before[-1:].isalnum() else "")


def any_of(phrases) -> str:
    return "(?:" + "|".join(map(phrase, phrases)) + ")"


def _caption(text: str, number: int | None, field: str) -> str:
    item = rf"(?:item\s+)?(?:{number}\s*[.)]\s*)?" if number else ""
    other = rf"(?!(?:\s+{any_of(CAPTION_WORDS[:2])})?\s*{CAPTION_WORDS[2]}\b)" if field == "class_type" else ""  # its code has a caption of its own
    return rf"(?i)^\s*{item}{phrase(text)}{other}"


CAPTIONS = {field: _caption(text, number, field) for text, number, field in CAPTION_TABLE}
CODE_CAPTION = {"class_type_code": rf"(?i)^\s*{phrase(CAPTION_TABLE[2][0])}(?:\s+{any_of(CAPTION_WORDS[:2])})?\s*{CAPTION_WORDS[2]}\b"}
STOPS = rf"(?i)^\s*(?:(?:item\s+)?\d{{1,2}}[a-z]?\s*[.)]\s*\S|{any_of([*STOP_PHRASES, *(text for text, _, _ in CAPTION_TABLE)])})"
QUALIFIER = rf"(?i)^\s*\p{{Ps}}\s*(?:{'|'.join(x.replace(' ', chr(92) + 's+') for x in INSTRUCTIONS)})\s*(?:\p{{Pe}}|[|1])?"
SEPARATORS = r"[\s:.\-\u2013]"
RESIDUE = rf"(?i)^(?:{SEPARATORS}*{any_of(CAPTION_WORDS)})+"
LEADING = r"^[\s:\-\u2013]+"
CODED = rf"^\s*(\d{{1,4}})\s*[-\u2013:]\s*(.+)$"
MARKS = rf"(?i){any_of(MARK_PHRASES)}"
PRODUCT_TYPES = {name: rf"(?i)\b{any_of(phrases)}" for name, phrases in PRODUCT_PHRASES.items()}


def bare(c: Column) -> Column:
    """c without the caption words and separators that it begins with; null if nothing is left."""
    plain = F.trim(F.regexp_replace(F.regexp_replace(c, RESIDUE, ""), LEADING, ""))
    return F.when(plain != "", plain)


def cleaned(c: Column) -> Column:
    """What is left of a caption's line, without instructions, caption words and separators; null if nothing."""
    return bare(F.regexp_replace(c, QUALIFIER, ""))


def caption_values(lines: DataFrame, *keys: str, captions: dict[str, str] = CAPTIONS) -> DataFrame:
    """(keys, field, value): the first line of each caption gives its rest, or the two lines below it, up to a blank or a stop, as one."""
    order = Window.partitionBy(*keys).orderBy("line_idx")
    ahead = lines.withColumn("one", F.lead("text", 1).over(order)).withColumn("two", F.lead("text", 2).over(order))
    stops = lambda c: F.coalesce((F.trim(c) == "") | c.rlike(STOPS), F.lit(True))
    field = F.explode(F.filter(F.array(*[F.when(F.col("text").rlike(p), F.struct(F.lit(f).alias("field"), F.regexp_replace("text", p, "").alias("rest"))) for f, p in captions.items()]), lambda x: x.isNotNull()))
    hits = ahead.select(*keys, "line_idx", "one", "two", field.alias("hit"))
    first = hits.groupBy(*keys, F.col("hit.field").alias("field")).agg(F.min_by(F.struct("hit.rest", "one", "two"), "line_idx").alias("at"))
    one, two = F.col("at.one"), F.col("at.two")
    below = F.when(~stops(one), bare(F.concat_ws(" ", F.trim(one), F.when(~stops(two), F.trim(two)))))
    return first.select(*keys, "field", F.coalesce(cleaned(F.col("at.rest")), below).alias("value"))


def text_values(lines: DataFrame, *keys: str) -> DataFrame:
    """(keys, brand_name, fanciful_name, class_type, class_type_code, alcohol_content, net_contents, beverage_type, found): a document's text.

    A class or type that starts with its code is parted from it; else the code is what the code's own caption has at its
    head. beverage_type is the one product type that the text names. found: the text gave any value, so it is an application's.
    """
    every = caption_values(lines, *keys, captions={**CAPTIONS, **CODE_CAPTION})
    of = lambda f: F.max(F.when(F.col("field") == f, F.col("value")))
    own = every.groupBy(*keys).agg(*[of(f).alias(f) for f in (*CAPTIONS, "class_type_code")])
    both = sole_type(lines, "text", *keys).withColumnRenamed("product_type", "beverage_type").join(own, list(keys), "left")
    coded = coded_type(F.col("class_type"))
    apart = F.regexp_extract("class_type_code", r"^(\d{1,4})\b", 1)
    code = F.coalesce(coded["code"], F.when(apart != "", apart))
    values = [F.col("brand_name"), F.col("fanciful_name"), F.when(F.col("class_type").isNotNull(), coded["name"]).alias("class_type"), code.alias("class_type_code"), F.col("alcohol_content"), F.col("net_contents"), F.col("beverage_type")]
    found = reduce(lambda a, b: a | b, [F.col(f).isNotNull() for f in (*CAPTIONS, "beverage_type")])
    return both.select(*keys, *values, found.alias("found"))


def coded_type(c: Column) -> Column:
    """struct (code, name) of a class or type that starts with its code."""
    code = F.regexp_extract(c, CODED, 1)
    return F.struct(F.when(code != "", code).alias("code"), F.when(code != "", F.trim(F.regexp_extract(c, CODED, 2))).otherwise(c).alias("name"))


def sole_type(df: DataFrame, text: str, *keys: str) -> DataFrame:
    """(keys, product_type): the one type that is named anywhere, null if none or several are."""
    named = {k: F.bool_or(F.col(text).rlike(p)) for k, p in PRODUCT_TYPES.items()}
    own = df.groupBy(*keys).agg(*[F.coalesce(c, F.lit(False)).alias(k) for k, c in named.items()])
    some = F.filter(F.array(*[F.when(F.col(k), F.lit(k)) for k in PRODUCT_TYPES]), lambda x: x.isNotNull())
    return own.select(*keys, F.when(F.size(some) == 1, some[0]).alias("product_type"))


def file_side(content_type: Column, head: Column, text: Column, decodable: Column, has_caption: Column) -> Column:
    """struct (side, basis) of a file; the first rule that applies decides. head: its first bytes."""
    rule = lambda side, basis: F.struct(F.lit(side).alias("side"), F.lit(basis).alias("basis"))
    return (
        F.when(F.coalesce(F.substring(head, 1, 4) == F.unhex(F.lit("25504446")), F.lit(False)), rule("application", "pdf_content"))
        .when(content_type == "application/pdf", rule("application", "pdf_declared"))
        .when(~decodable, rule("label", "undecodable"))
        .when(text.rlike(MARKS), rule("application", "form_marks"))
        .when(has_caption, rule("application", "captions"))
        .otherwise(rule("label", "no_marks"))
    )


def by_area(*keys: str):
    """The order in which panels are read: the largest first, then by page and place."""
    return Window.partitionBy(*keys).orderBy(F.desc("pixels"), "page", "ordinal")


def scan(panels: DataFrame, *keys: str, settings: Settings = DEFAULT) -> DataFrame:
    """panels (keys, ordinal, page, pixels, reads, has_text, satisfies) with rank and status, largest first.

    too_small: under the least area. not_read: beyond the first 8. A panel is read while the reads before it are below the
    budget and no panel before satisfied: read or no_text; else not_needed or not_reached, whichever came first. A panel that
    can't be decoded has a null has_text: in its turn it is undecodable, costs no reads and satisfies nothing.
    """
    own = panels.withColumn("fits", F.col("pixels") >= settings.min_pixels)
    order = by_area(*keys, "fits")
    past = order.rowsBetween(Window.unboundedPreceding, -1)
    charged = F.when(F.col("has_text").isNotNull(), F.col("reads"))
    ranked = own.withColumn("rank", F.row_number().over(order)).withColumn("spent", F.coalesce(F.sum(charged).over(past), F.lit(0))).withColumn("over", F.coalesce(F.max((F.col("satisfies") & F.col("has_text")).cast("int")).over(past), F.lit(0)))
    stop = Window.partitionBy(*keys, "fits").orderBy("rank").rowsBetween(Window.unboundedPreceding, 0)
    spent_at = F.min(F.when(F.col("spent") >= settings.max_reads, F.col("rank"))).over(stop)
    over_at = F.min(F.when(F.col("over") == 1, F.col("rank"))).over(stop)
    status = (
        F.when(~F.col("fits"), "too_small").when(F.col("rank") > settings.max_pictures, "not_read")
        .when(over_at.isNotNull() & (spent_at.isNull() | (over_at <= spent_at)), "not_needed").when(spent_at.isNotNull(), "not_reached")
        .when(F.col("has_text").isNull(), "undecodable").when(F.col("has_text"), "read").otherwise("no_text")
    )
    return ranked.withColumn("status", status).drop("fits", "spent", "over")


def coalesced(base: DataFrame, sources: list[tuple[str, DataFrame]], *keys: str) -> DataFrame:
    """(keys, value, source): the value of the first source that has one; sources are (name, table of keys and value)."""
    out, values, names = base.select(*keys).distinct(), [], []
    for i, (name, table) in enumerate(sources):
        out = out.join(table.select(*keys, F.col("value").alias(f"v{i}")), list(keys), "left")
        usable = F.when(F.trim(F.col(f"v{i}")) != "", F.col(f"v{i}"))
        values.append(usable)
        names.append(F.when(usable.isNotNull(), F.lit(name)))
    return out.select(*keys, F.coalesce(*values).alias("value"), F.coalesce(*names, F.lit("absent")).alias("source"))


#: Why a file was taken for what it is, and what is said of that.
BASES = {
    "pdf_content": "It is a PDF, and so an application.",
    "pdf_declared": "It was sent as a PDF, and so is an application.",
    "form_marks": "It has the form's own wording, and so is an application.",
    "captions": "It has the form's captions with values, and so is an application.",
    "no_marks": "It has nothing of the form, and so is a label.",
    "undecodable": "It could not be opened, and is taken for a label.",
}


def form_values(widgets: DataFrame, *keys: str) -> DataFrame:
    """(keys, field, value) of form widgets (keys, idx, name, value, checked, export): the first that has a value.

    Brand and fanciful name are known by their caption in the widget's name; a checked widget of the product type gives
    the type whose name its export value starts.
    """
    named = F.when(F.col("name").rlike(rf"(?i)\b{phrase('brand name')}"), "brand_name").when(F.col("name").rlike(rf"(?i)\b{phrase('fanciful name')}"), "fanciful_name")
    export = F.regexp_replace(F.lower("export"), "[^a-z]", "")
    kinds = F.when(export == "spirits", "distilled spirits")
    for kind, words in PRODUCT_PHRASES.items():
        kinds = kinds.when(export.isin(*{w.replace(" ", "") for w in words}, kind.split()[0] if kind != "distilled spirits" else "distilledspirits"), kind)
    typed = F.col("name").rlike(rf"(?i)check\s*box\s*22|{phrase('type of product')}") & F.coalesce(F.col("checked"), F.lit(False))
    rows = widgets.select(*keys, "idx", F.explode(F.array(F.struct(named.alias("field"), F.col("value").alias("value")), F.struct(F.when(typed, "beverage_type").alias("field"), kinds.alias("value")))).alias("x"))
    kept = rows.select(*keys, "idx", "x.*").where("field IS NOT NULL AND trim(value) <> ''")
    return kept.groupBy(*keys, "field").agg(F.min_by("value", "idx").alias("value"))


def ticked(boxes: DataFrame, *keys: str, margin: float = TICK_MARGIN) -> DataFrame:
    """(keys, value, separation, reason) of boxes (keys, option, luminance): the darkest, if it is darker than the next by the margin.

    not_located: an option is missing; unreadable: a box has no luminance; too_close or ticked.
    """
    own = boxes.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("luminance", "option"))).alias("o"), F.sort_array(F.collect_set("option")).alias("options"), F.count("luminance").alias("read"))
    options = F.sort_array(F.array(*map(F.lit, PRODUCT_PHRASES)))
    apart = F.get("o", F.lit(1))["luminance"] - F.get("o", F.lit(0))["luminance"]
    reason = F.when(F.col("options") != options, "not_located").when(F.col("read") < F.size("options"), "unreadable").when(apart < margin, "too_close").otherwise("ticked")
    sampled = own.withColumn("reason", reason).withColumn("separation", F.when(F.col("reason").isin("ticked", "too_close"), F.round(apart, 1)))
    return sampled.select(*keys, F.when(F.col("reason") == "ticked", F.get("o", F.lit(0))["option"]).alias("value"), "separation", "reason")


def satisfied(panels: DataFrame, *keys: str) -> DataFrame:
    """panels (keys, rank, brand_name, class_type, alcohol_content, net_contents, warning: found on it) with satisfies.

    True where the panels up to this one show all five. For declared values, found is a hit at match level.
    """
    so_far = Window.partitionBy(*keys).orderBy("rank").rowsBetween(Window.unboundedPreceding, 0)
    shown = [F.coalesce(F.bool_or(F.col(c)).over(so_far), F.lit(False)) for c in ("brand_name", "class_type", "alcohol_content", "net_contents", "warning")]
    every = shown[0]
    for c in shown[1:]:
        every = every & c
    return panels.withColumn("satisfies", every)


def merged(text: DataFrame, panels: DataFrame, ticks: DataFrame, *keys: str) -> DataFrame:
    """(keys, field, value, source, panel): the document's values.

    text: keys, field, value, source (form_fields or embedded_text); panels: keys, field, value, confidence, rank; ticks: as
    ticked(). A panel fills only what the text left empty, the surest first, then the larger. A product type that the text
    only implies gives way to sampled boxes, even where none stands out; one of a form field stays.
    """
    names = [*keys, "field"]
    own = panels.where("value IS NOT NULL").groupBy(*names).agg(F.max_by(F.struct("value", "rank"), F.struct("confidence", -F.col("rank"))).alias("p"))
    both = text.join(own, names, "full_outer").withColumn("filled", F.col("value").isNull() & F.col("p").isNotNull())
    both = both.select(*names, F.coalesce("value", "p.value").alias("value"), F.when(F.col("filled"), "embedded_artwork").when(F.col("value").isNotNull(), F.col("source")).alias("source"), F.when(F.col("filled"), F.col("p.rank")).alias("panel"))
    sampled = ticks.where("reason IN ('ticked', 'too_close')").select(*keys, F.lit("beverage_type").alias("field"), F.col("value").alias("tick"), F.lit(True).alias("sampled"))
    out = both.join(sampled, names, "full_outer")
    over = F.coalesce("sampled", F.lit(False)) & (F.col("value").isNull() | (F.col("source") == "embedded_text"))
    return out.select(*names, F.when(over, F.col("tick")).otherwise(F.col("value")).alias("value"), F.when(over, F.when(F.col("tick").isNotNull(), "product_type_box")).otherwise(F.col("source")).alias("source"), F.when(~over, F.col("panel")).alias("panel")).where("value IS NOT NULL")


def notes(values: DataFrame, reads: DataFrame, fields: tuple[str, ...], *keys: str) -> DataFrame:
    """(keys, notes): codes of what there is to say of a document: values (keys, field, value, source), reads (keys, pages_left, panels_left).

    no:<field> for each absent field, in their order; budget where pages or panels were left; self_consistency where a value
    comes from the artwork.
    """
    have = values.where("value IS NOT NULL").groupBy(*keys).agg(F.collect_set("field").alias("have"), F.bool_or(F.col("source") == "embedded_artwork").alias("own"))
    seen = reads.join(have, list(keys), "left")
    absent = F.transform(F.filter(F.array(*map(F.lit, fields)), lambda f: ~F.coalesce(F.array_contains("have", f), F.lit(False))), lambda f: F.concat(F.lit("no:"), f))
    more = F.array_compact(F.array(F.when(F.col("pages_left") + F.col("panels_left") > 0, "budget"), F.when(F.coalesce("own", F.lit(False)), "self_consistency")))
    return seen.select(*keys, F.concat(absent, more).alias("notes"))


def needs_pages(form_values: Column, text_values: Column) -> Column:
    """Pages are read as pictures only where neither form fields nor the text layer gave anything."""
    return (F.coalesce(form_values, F.lit(0)) == 0) & (F.coalesce(text_values, F.lit(0)) == 0)


def pending(items: DataFrame, values: DataFrame, fields: tuple[str, ...], *keys: str) -> DataFrame:
    """(keys, field): of items (keys, artwork_read, pictures) whose pictures are yet to be read, the fields not found so far."""
    open_ = items.where("NOT artwork_read AND pictures > 0").select(*keys, F.explode(F.array(*map(F.lit, fields))).alias("field"))
    return open_.join(values.where("value IS NOT NULL").select(*keys, "field"), [*keys, "field"], "left_anti")


def caption_box(words: DataFrame, stems: tuple[str, ...], *keys: str) -> DataFrame:
    """(keys, left, top, right, bottom): the first run of words that begin with the stems, in any case, on one line.

    words: keys, word_idx, text, left, top, right, bottom. Tops within half the tallest word's height are one line.
    """
    order = Window.partitionBy(*keys).orderBy("word_idx")
    box = F.struct("text", "left", "top", "right", "bottom")
    ahead = words.select(*keys, "word_idx", F.array(*[F.lead(box, i).over(order) if i else box for i in range(len(stems))]).alias("run"))
    for i, stem in enumerate(stems):
        ahead = ahead.where(F.startswith(F.lower(F.col("run")[i]["text"]), F.lit(stem)))
    part = lambda c: F.transform("run", lambda w: w[c])
    tall = F.array_max(F.transform("run", lambda w: w["bottom"] - w["top"]))
    level = ahead.where(F.array_max(part("top")) - F.array_min(part("top")) <= tall * 0.5)
    first = level.groupBy(*keys).agg(F.min_by("run", "word_idx").alias("run"))
    return first.select(*keys, F.array_min(part("left")).alias("left"), F.array_min(part("top")).alias("top"), F.array_max(part("right")).alias("right"), F.array_max(part("bottom")).alias("bottom"))
