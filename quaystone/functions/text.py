"""Text functions as column expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Phrases that speak for a question about data, and for one about concepts.
DATA_MARKERS = (
    "how many", "how much", "which station", "which stations", "which train", "which relation", "which operator", "worst", "best", "highest", "lowest", "most delayed", "least", "top ", "rank",
    "average delay", "total", "count", "compare", "trend", "per day", "per hour", "per station", "by station", "by hour", "by month", "last week", "last month", "list ", "show me",
)
CONCEPT_MARKERS = (
    "why is", "why are", "why does", "why do", "what does it mean", "what is meant", "how is punctuality", "how do you define", "how is it defined", "what does", "how does the", "how was",
    "where does the data", "who publishes", "explain", "definition", "architecture", "limitation", "known issue", "modelled", "modeled", "design",
)
#: Chunk sizes in characters.
MAX_CHARS, MIN_CHARS = 1500, 120


#: Where a URL holds a password, and how a secret's name is followed by its value.
URL_PASSWORD = r"(://[^:/@\s]+:)[^@/\s]+@"
NAMED_SECRET = r"(?i)(password|passwd|pwd|secret|token|api[_-]?key)(['\"]?\s*[:=]\s*['\"]?)[^'\"\s,;]+"


def flat(text: Column) -> Column:
    """White space of any script collapsed to single blanks, none at the ends."""
    return F.trim(F.regexp_replace(text, r"(?U)[\s\x1C-\x1F]+", " "))


def folded(text: Column) -> Column:
    """A key to compare headings by: without case and spacing."""
    return F.lower(flat(text))


def line_shape(text: Column) -> Column:
    """A line without spacing and digits, so that page numbers do not tell running lines apart; case does."""
    return F.regexp_replace(flat(text), r"(?U)\d+", "#")


def redact(text: Column) -> Column:
    """Credentials masked: the password in a URL, and the value after a secret's name."""
    return F.regexp_replace(F.regexp_replace(text, URL_PASSWORD, "$1***@"), NAMED_SECRET, "$1$2***")


def question_print(text: Column) -> tuple[Column, Column]:
    """Hash and length by which a question is logged instead of its words."""
    return F.left(F.sha2(text, 256), F.lit(12)), F.length(text)


def embedding_text(heading: Column, content: Column) -> Column:
    """What is embedded and hashed: the heading, unless null or empty, above the content."""
    return F.concat_ws("\n\n", F.nullif(heading, F.lit("")), content)


def content_hash(heading: Column, content: Column) -> Column:
    return F.sha2(embedding_text(heading, content), 256)


def markers(text: Column, phrases: tuple[str, ...]) -> Column:
    low = F.lower(text)
    return reduce(lambda a, b: a + b, [F.when(F.contains(low, F.lit(p)), 1).otherwise(0) for p in phrases])


def route(text: Column) -> Column:
    """data or conceptual where phrases of one kind only occur, else null: a mixed question is not decided here. A bare year speaks for data."""
    data = markers(text, DATA_MARKERS) + F.when(text.rlike(r"\b(19|20)\d{2}\b"), 1).otherwise(0)
    concept = markers(text, CONCEPT_MARKERS)
    return F.when((data > 0) & (concept == 0), F.lit("data")).when((concept > 0) & (data == 0), F.lit("conceptual"))


#: Whatever ends a line, as a pattern.
LINE_END = "\r\n|[\n\r\u000b\u000c\u001c\u001d\u001e\u0085\u2028\u2029]"
#: What parts two paragraphs.
PARAGRAPH_BREAK = r"(?U)\n\s*\n"


def hard_split(text: Column, size: int) -> Column:
    """Fixed-length pieces of a text, the last one shorter; an empty text has none."""
    return F.when(F.length(text) > 0, F.transform(F.sequence(F.lit(1), F.length(text), F.lit(size)), lambda i: F.substring(text, i, F.lit(size)))).otherwise(F.array().cast("array<string>"))


def sections(df: DataFrame, doc_id: str, text: str) -> DataFrame:
    """doc_id, section_no, heading, body: a document cut at its Markdown headings; text above the first heading is section 0.

    Lines are numbered inside the document's own array, so there is no shuffle: a fold over the array opens a section at each heading.
    """
    empty = F.array().cast("array<struct<heading:string,lines:array<string>>>")

    def step(done: Column, line: Column) -> Column:
        heading = F.regexp_extract(line, r"^#{1,6}\s+(.*?)\s*$", 1)
        last = F.element_at(done, -1)
        grown = F.concat(F.slice(done, F.lit(1), F.size(done) - 1), F.array(F.struct(last["heading"].alias("heading"), F.concat(last["lines"], F.array(line)).alias("lines"))))
        opened = F.concat(done, F.array(F.struct(F.when(line.rlike(r"^#{1,6}\s+"), heading).alias("heading"), F.when(line.rlike(r"^#{1,6}\s+"), F.array().cast("array<string>")).otherwise(F.array(line)).alias("lines"))))
        return F.when(line.rlike(r"^#{1,6}\s+") | (F.size(done) == 0), opened).otherwise(grown)

    lines = F.split(F.col(text), LINE_END)
    cut = df.select(F.col(doc_id), F.posexplode(F.aggregate(lines, empty, step)).alias("section_no", "s"))
    out = cut.select(doc_id, "section_no", F.col("s.heading").alias("heading"), F.regexp_replace(F.array_join("s.lines", "\n"), r"(?U)^[\s\x1C-\x1F]+|[\s\x1C-\x1F]+$", "").alias("body"))
    return out.where(F.col("body") != "")


def packed(body: Column, limit: int = MAX_CHARS) -> Column:
    """A body as pieces of at most ``limit`` characters: as it is if it fits, else its paragraphs joined in order as far as they fit.

    A paragraph longer than the limit is cut hard, and nothing is joined to its pieces. A fold inside the row, without a shuffle.
    """
    start = F.struct(F.array().cast("array<string>").alias("parts"), F.lit("").alias("open"))

    def step(done: Column, paragraph: Column) -> Column:
        joined = F.when(done["open"] == "", paragraph).otherwise(F.concat(done["open"], F.lit("\n\n"), paragraph))
        closed = F.when(done["open"] == "", done["parts"]).otherwise(F.concat(done["parts"], F.array(done["open"])))
        return (
            F.when(F.length(joined) <= limit, F.struct(done["parts"].alias("parts"), joined.alias("open")))
            .when(F.length(paragraph) <= limit, F.struct(closed.alias("parts"), paragraph.alias("open")))
            .otherwise(F.struct(F.concat(closed, hard_split(paragraph, limit)).alias("parts"), F.lit("").alias("open")))
        )

    pieces = F.aggregate(F.split(body, PARAGRAPH_BREAK), start, step, lambda x: F.when(x["open"] == "", x["parts"]).otherwise(F.concat(x["parts"], F.array(x["open"]))))
    return F.when(F.length(body) <= limit, F.array(body)).otherwise(pieces)


def merge_short(df: DataFrame, doc_id: str, order: str, text: str, least: int = MIN_CHARS) -> DataFrame:
    """Pieces under ``least`` characters folded into the piece before, across headings; a short first piece stays."""
    w = Window.partitionBy(doc_id).orderBy(order)
    begins = F.when((F.length(text) >= least) | (F.row_number().over(w) == 1), 1).otherwise(0)
    grouped = df.withColumn("__qs_g", F.sum(begins).over(w))
    parts = F.sort_array(F.collect_list(F.struct(order, text)))
    return grouped.groupBy(doc_id, "__qs_g").agg(F.min(order).alias(order), parts.alias("__qs_p")).select(doc_id, order, F.array_join(F.transform("__qs_p", lambda x: x[text]), "\n\n").alias(text))


def chunks(df: DataFrame, doc_id: str, text: str, limit: int = MAX_CHARS, least: int = MIN_CHARS) -> DataFrame:
    """doc_id, chunk_index, heading, content, content_hash: sections, packed to size, short pieces merged."""
    cut = sections(df, doc_id, text)
    pieces = cut.select(doc_id, "section_no", "heading", F.posexplode(packed(F.col("body"), limit)).alias("part_no", "content"))
    pieces = pieces.withColumn("at", F.col("section_no") * 1_000_000 + F.col("part_no"))
    merged = merge_short(pieces, doc_id, "at", "content", least).join(pieces.select(doc_id, "at", "heading"), [doc_id, "at"])
    index = (F.row_number().over(Window.partitionBy(doc_id).orderBy("at")) - 1).alias("chunk_index")
    return merged.select(doc_id, index, "heading", "content", content_hash(F.col("heading"), F.col("content")).alias("content_hash"))


def glossary(blocks: DataFrame, doc: str, order: str, key: str, labels: dict[str, str]) -> DataFrame:
    """Rows of a parsed glossary table folded to entries: a row without its key continues the entry before it in the section.

    ``labels`` names the other columns; their values carry the label only if there are several.
    """
    w = Window.partitionBy(doc).orderBy(order)
    rows = blocks.where("kind = 'table_row'").withColumn("term", flat(F.coalesce(F.element_at("cells", key), F.lit(""))))
    rows = rows.withColumn("entry", F.sum(F.when(F.col("term") != "", 1).otherwise(0)).over(w))
    fields = [F.when(F.trim(F.element_at("cells", c)) != "", F.concat(F.lit(f"{label}: " if len(labels) > 1 else ""), F.trim(F.element_at("cells", c)))) for c, label in labels.items()]
    body = F.concat_ws("\n\n", *fields)
    parts = F.sort_array(F.collect_list(F.struct(F.col(order).alias("at"), F.col("term"), F.col("section"), body.alias("body"))))
    folded = rows.groupBy(doc, "entry").agg(parts.alias("p"))
    content = F.array_join(F.filter(F.transform("p", lambda x: x["body"]), lambda b: b != ""), "\n\n")
    term, section = F.col("p")[0]["term"], flat(F.col("p")[0]["section"])
    return folded.select(doc, (F.col("entry") - 1).alias("chunk_index"), F.concat(section, F.lit(" — "), term).alias("heading"), F.when(content == "", term).otherwise(content).alias("content"), (F.col("entry") == 0).alias("has_no_entry"))
