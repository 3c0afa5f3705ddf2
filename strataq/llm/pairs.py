"""Functions paired with their documentation.

Files are lexed into rows once; everything after is SQL over the rows: a
running sum of brackets gives each token's depth, the tokens of a head form an
island whose own-depth tokens tell what it declares, heads at depth 0 (methods
at depth 1 of a class) count, adjoining comments form islands, and lag attaches
the island that ends on the line above.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType

from strataq.common import spread
from strataq.llm.lexing import lex

TOKENS = "file_id long, copy long, go boolean, line int, last_line int, pos int, stop int, kind string, text string"
#: What a delivered text is known by; windows never mix two texts that came under one id.
DELIVERY = ["file_id", "copy"]


def _delivered(files: DataFrame) -> DataFrame:
    """Files with something in them, and copy, a number that tells texts under one id apart."""
    rows = files.select("file_id", "file_name", "code_language", "body").where(F.length("body") > 0)
    return rows.withColumn("copy", F.xxhash64("file_name", "code_language", "body"))


def tokens(files: DataFrame) -> DataFrame:
    """One row per token that matters. Null, empty and foreign bodies give none; texts are read whole."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for i, copy, name, lang, body in zip(b["file_id"], b["copy"], b["file_name"], b["code_language"], b["body"]):
                go = str(name or "").lower().endswith(".go") or ("." not in str(name or "") and str(lang).strip().lower() == "go")
                rows += [(i, copy, go, *t) for t in lex(body, name, lang)]
            yield pd.DataFrame(rows, columns=["file_id", "copy", "go", "line", "last_line", "pos", "stop", "kind", "text"])

    return spread(_delivered(files)).mapInPandas(run, TOKENS)


def _with_depth(rows: DataFrame) -> DataFrame:
    """Tokens with depth, the number of brackets around them. The tokens of a row delivered again count once."""
    w = Window.partitionBy(*DELIVERY).orderBy("pos", F.desc("kind"))  # a parenthesis is a sign of its head, then a bracket
    kind = F.col("kind")
    again = (F.lag("pos").over(w) == F.col("pos")) & (F.lag("kind").over(w) == kind)
    rows = rows.withColumn("again", F.coalesce(again, F.lit(False))).where("NOT again").drop("again")
    opens, closes = kind.isin("o", "O").cast("int"), kind.isin("c", "C").cast("int")
    return rows.withColumn("depth", F.sum(opens - closes).over(w.rowsBetween(Window.unboundedPreceding, 0)) - opens)


def _heads(deep: DataFrame) -> DataFrame:
    """Comments and heads that may count, with island (number of the head a token belongs to), head_depth and owner (the
    top-level class around them, or '')."""
    w = Window.partitionBy(*DELIVERY).orderBy("pos", F.desc("kind"))
    upto = w.rowsBetween(Window.unboundedPreceding, 0)
    kind, text, depth = F.col("kind"), F.col("text"), F.col("depth")
    near = deep.where((depth == 0) | (depth == 1) & ~kind.isin("o", "c"))
    near = near.withColumn("before", F.lag("text").over(w)).withColumn("on_head", F.coalesce(F.lag("kind").over(w).isin("h", "w"), F.lit(False)))
    own = (  # what a token at depth 0 says about the class that what follows lies in; null: nothing
        F.when(depth != 0, None)
        .when(kind.isin("w", "O") & (F.col("before") == "class") & F.col("on_head"), F.when((kind == "O") | text.isin("extends", "implements"), "").otherwise(text))
        .when(kind == "h", "")
        .when((kind == "o") & ~((text == "{") & F.col("on_head")), "")
    )
    return (
        near.withColumn("owner", F.coalesce(F.last(own, ignorenulls=True).over(upto), F.lit("")))
        .withColumn("island", F.sum((kind == "h").cast("int")).over(upto))
        .withColumn("head_depth", F.last(F.when(kind == "h", depth), ignorenulls=True).over(upto))
        .drop("before", "on_head")
    )


_NAME = r"([^\s()<>\[\]{}?*=:;,.!|&+/\-]+)"
_MODIFIERS = r"(?:(?:public|private|protected|static|abstract|override|readonly|async|declare|accessor|get|set) )*"
#: How the words and signs of a head at its own depth read, parted by blanks; what brackets hold is left out.
_GO_FUNCTION = rf"^func (?:\( \) )?{_NAME} [(\[]"
_GO_RECEIVER = rf"^func \( (?:{_NAME} )?(\* )?{_NAME} (?:\[ ([^\]]*) \] )?(?:, )?\) "
_FUNCTION = rf"^(?:export )?(?:default )?(?:declare )?(?:async )?function (?:\* )?{_NAME}"
_BOUND = rf"^(?:export )?(?:declare )?const {_NAME} (?:: .*? )?= (?:async )?(?:function(?: |$)|[^\s()]+ =>|(?:< .*? > )?\( \) (?:: .*? )?=>)"
_METHOD = rf"^{_MODIFIERS}(?:\* )?{_NAME} (?:\? )?(?:< .*? > )?\("


def _islands(deep: DataFrame) -> DataFrame:
    """(file_id, copy, go, pos, line, last_line, depth, doc, element_name), one row per comment and per declaration.

    A head is an island of tokens: its name is read off the tokens at its own
    depth, a receiver off those within. Adjoining comments of Go are one island.
    """
    w = Window.partitionBy(*DELIVERY).orderBy("pos", F.desc("kind"))
    is_doc = F.col("kind") == "k"
    of_head = F.col("kind").isin("h", "w", "O", "C") & ((F.col("head_depth") == 0) | (F.col("head_depth") == 1) & (F.col("owner") != "") & ~F.col("go"))
    kept = _heads(deep).where(is_doc | of_head)
    joins = is_doc & (F.lag("kind").over(w) == "k") & (F.lag("last_line").over(w) == F.col("line") - 1) & F.col("go")
    runs = kept.withColumn("run", F.when(is_doc, F.sum(F.when(joins | ~is_doc, 0).otherwise(1)).over(w.rowsBetween(Window.unboundedPreceding, 0))).otherwise(-F.col("island")))
    own = ~is_doc & (F.col("depth") == F.col("head_depth"))
    said = lambda when, glue: F.array_join(F.transform(F.array_sort(F.collect_list(F.when(when, F.struct("pos", "text")))), lambda x: x["text"]), glue)
    parts = runs.groupBy(*DELIVERY, "run").agg(
        F.min("pos").alias("pos"),
        F.min("line").alias("line"),
        F.max("last_line").alias("last_line"),
        F.first("go").alias("go"),
        F.min_by("depth", "pos").alias("depth"),
        F.min_by("owner", "pos").alias("owner"),
        said(is_doc, "\n").alias("doc"),
        said(own, " ").alias("head"),
        said(~is_doc & F.col("go"), " ").alias("whole"),
    )
    head, whole = F.col("head"), F.col("whole")
    part = lambda text, pattern, i: F.regexp_extract(text, pattern, i)
    receiver = part(whole, _GO_RECEIVER, 3)
    args = part(whole, _GO_RECEIVER, 4)
    recv = F.concat(F.lit("("), F.trim(part(whole, _GO_RECEIVER, 2)), receiver, F.when(args != "", F.concat(F.lit("["), F.regexp_replace(args, r"\s*,\s*", ", "), F.lit("]"))).otherwise(""), F.lit(")."))
    plain = part(head, _GO_FUNCTION, 1)
    go_name = F.when(head.startswith("func ( )"), F.when(receiver != "", F.concat(recv, plain))).otherwise(plain)
    script_name = F.when(F.col("depth") == 0, F.coalesce(*[F.nullif(part(head, p, 1), F.lit("")) for p in (_FUNCTION, _BOUND)])).otherwise(F.concat("owner", F.lit("."), F.nullif(part(head, _METHOD, 1), F.lit(""))))
    name = F.when(F.col("run") > 0, None).when(F.col("go"), F.when(plain != "", go_name)).otherwise(script_name)
    return parts.select(*DELIVERY, "go", "pos", "line", "last_line", "depth", F.when(F.col("run") > 0, F.col("doc")).alias("doc"), name.alias("element_name")).where("doc IS NOT NULL OR element_name IS NOT NULL")


def _attached(islands: DataFrame) -> DataFrame:
    """(file_id, copy, go, line, pos, depth, element_name, doc) per declaration with a comment on the line above."""
    w = Window.partitionBy(*DELIVERY).orderBy("pos")
    above = islands.withColumn("over", F.lag("doc").over(w)).withColumn("doc_ends", F.lag("last_line").over(w))
    return (
        above.where(F.col("element_name").isNotNull() & F.col("over").isNotNull() & (F.col("doc_ends") == F.col("line") - 1))
        .where(F.col("go") | F.col("over").startswith("/**"))
        .select(*DELIVERY, "go", "line", "pos", "depth", "element_name", F.col("over").alias("doc"))
    )


_MARKS = re.compile(r"^[ \t]*(?://+|/\*+|\*+/|\*+(?!/)|#+)?|\*+/[ \t\r]*$", re.M)
#: Forms of documentation that say nothing.
_DIRECTIVE = re.compile(r"^(?:go:|nolint\b|lint:|line |extern |export |\+build|eslint|tslint|ts-|@ts-|prettier|istanbul|c8 |v8 |jshint|jslint|global |globals |exported |noinspection|webpack|#__|biome|stylelint|#nosec|nosec|gosec|revive:|staticcheck|cspell|spell|[a-z0-9]+:[a-z0-9])", re.I)
_DIRECTIVE_GO = re.compile(r"^[a-z0-9]+:[a-z0-9]\S*")
_TAG = re.compile(r"^@\w+")
_PLACEHOLDER = re.compile(
    r"^[\W_]*(?:todo|fixme|xxx|hack|tbd|wip|n/?a|none|nothing|description|desc|docs?|documentation|comment|placeholder|undocumented|no (?:description|documentation|docs?|comment)s?(?: yet| provided| available)?|"
    r"(?:please )?(?:add|write|insert|missing|needs|pending)(?: (?:an?|the|some|more|proper|your|this))* (?:descriptions?|desc|docs?|documentation|(?:doc(?:umentation)? )?comments?|docstrings?|text|summary|explanation)(?: (?:here|later|soon|for this))*|"
    r"missing|pending|needs (?:to be (?:documented|done|written|described|added)|documenting)|lorem ipsum\b[^.]{0,40}|to be (?:documented|done|written|described|added)|document (?:me|this)|\.{2,}|…|\?+|-+)[\W_]*$",
    re.I,
)
#: The first word of a line; where it is the element's own name a sentence about it follows.
_FIRST = re.compile(r"[\W_]*(\w*)")
_UNFINISHED = re.compile(r"^[\W_]*(?:todo|fixme|xxx|hack|tbd)\b", re.I)
_CODE = re.compile(
    r"^(?:(?:return|break|continue|goto|defer|go|if|for|switch|case|else|func|var|const|let|type|import|package|function|class|export|await|throw|try|catch)\b.*[(){}\[\];=:,]|return\b(?:\s+[\w.\"']+(?:\s*,\s*[\w.\"']+)*)?\s*;?|"
    r"[\w.\[\]*&$]+(?:\s*,\s*[\w.\[\]*&$]+)*\s*(?:[:+\-*/|&]?=)(?!=)\s*\S.*|[\w.$\[\]]+\([^)]*\)(?:\.[\w$]+\([^)]*\))*\s*;?|[{}()\[\];,]+|\}?\s*else\s*\{?|.*[;{]|break;?|continue;?)$"
)
_WORD = re.compile(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+|\d+|[^\W\d_a-zA-Z]+")


#: Words that say nothing by themselves.
_FILLING = frozenset(["a", "an", "the", "this", "that", "its", "it", "of", "to"])


def _forms(word: str) -> set[str]:
    """A word and what it may be an inflected form of: packs, packed, packing; tallies; hashes; trimmed."""
    out = {word}
    for ending, put in (("ies", "y"), ("es", ""), ("s", ""), ("ied", "y"), ("ed", ""), ("ed", "e"), ("ing", ""), ("ing", "e")):
        if word.endswith(ending) and len(word) - len(ending) >= 2:
            stem = word[: -len(ending)] + put
            out.add(stem)
            if ending in ("ed", "ing") and len(stem) > 2 and stem[-1] == stem[-2]:
                out.add(stem[:-1])
    return out


def doc_lines(doc: str) -> list[str]:
    """The lines of a comment without its marks and outer blanks."""
    out = []
    for line in doc.replace("\r", "").split("\n"):
        line = line.strip()
        line = re.sub(r"\*+/$", "", line).strip() if line.endswith("*/") else line
        line = re.sub(r"^(?:/\*+|//+|\*+(?!/))", "", line).strip()
        out.append(line)
    return out


def is_trivial(doc: str, element: str) -> bool:
    """Whether a comment holds nothing besides marks, directives, tags, placeholders, dividers, headings, disabled code or its element's words, inflected or with articles as may be."""
    rest: list[str] = []
    in_tag = False
    for raw in doc.replace("\r", "").split("\n"):
        stripped = raw.strip()
        (line,) = doc_lines(raw)
        if not line:
            in_tag = False
            continue
        if _TAG.match(line):
            in_tag = True
            continue
        directive = _DIRECTIVE.match(line) if not stripped.startswith("//") else None
        if stripped.startswith("//") and not stripped.startswith("// ") and _DIRECTIVE_GO.match(line):
            directive = True
        if directive or re.match(r"^(?:nolint|lint:|eslint-|tslint:|ts-|@ts-|prettier-|istanbul |\+build|#nosec|noinspection)", line):
            continue
        if in_tag and raw.startswith((" *   ", "   ")):
            continue
        rest.append(line)
    if not rest:
        return True
    text = [x for x in rest if re.search(r"[^\W_]", x)]
    text = [x for x in text if not re.fullmatch(r"(?:[-=*#~_+/.<>|]{2,}\s*.{0,60}?\s*[-=*#~_+/.<>|]{2,}|#{1,6}\s.*|[-=*#~_+/|]{3,}\s*\S.{0,50})", x)]
    if not text:
        return True
    name = element.rsplit(".", 1)[-1].lower()
    if all(_PLACEHOLDER.match(x) and _FIRST.match(x).group(1).lower() != name or _UNFINISHED.match(x) and len(x.split()) <= 4 for x in text):
        return True
    if all(_CODE.match(x) for x in text):
        return True
    own = {f for w in _WORD.findall(element) for f in _forms(w.lower())}
    return all(w.lower() in _FILLING or _forms(w.lower()) & own for x in text for w in _WORD.findall(x))


@F.pandas_udf(BooleanType())
def _trivial(doc: pd.Series, element: pd.Series) -> pd.Series:
    return pd.Series([is_trivial(d, e) for d, e in zip(doc, element)])


def documented(files: DataFrame) -> DataFrame:
    """(file_id, line_no, element_name) of the functions with documentation that says something.

    A file delivered again gives its functions again; ties, repeated rows and
    extra columns make no difference; an empty table gives no rows.
    """
    found = _attached(_islands(_with_depth(tokens(files))))
    return found.where(~_trivial("doc", "element_name")).select("file_id", F.col("line").alias("line_no"), "element_name")


def pairs(files: DataFrame) -> DataFrame:
    """documented() with doc and code: the text from the declaration to the bracket that closes its body."""
    deep = _with_depth(tokens(files))
    w = Window.partitionBy(*DELIVERY).orderBy("pos")
    opening = (F.lead("text").over(w) == "{") & (F.lead("line").over(w) == F.col("line"))  # of a result type, before the body
    closes = F.col("kind").isin("c", "C") & (F.col("text") == "}") & ~F.coalesce(opening, F.lit(False))
    ends = deep.withColumn("closes", closes)
    after = w.rowsBetween(1, Window.unboundedFollowing)
    for level in (0, 1):
        ends = ends.withColumn(f"end{level}", F.min(F.when(F.col("closes") & (F.col("depth") == level), F.col("stop"))).over(after))
    ends = ends.where((F.col("kind") == "h") & (F.col("depth") <= 1)).select(*DELIVERY, "pos", "depth", F.when(F.col("depth") == 0, F.col("end0")).otherwise(F.col("end1")).alias("end"))
    islands = _islands(deep)
    next_one = islands.where("element_name IS NOT NULL").withColumn("next", F.lead("pos").over(w)).select(*DELIVERY, "pos", "next")
    spans = next_one.join(ends, [*DELIVERY, "pos"]).select(*DELIVERY, "pos", F.when(F.col("next").isNull() | (F.col("end") <= F.col("next")) | (F.col("depth") == 0) & (F.col("end") < F.col("next")), F.col("end")).alias("stop"))
    docs = _attached(islands).where(~_trivial("doc", "element_name")).join(spans, [*DELIVERY, "pos"])
    body = F.col("body")
    code = F.when(F.col("stop").isNotNull(), F.substring(body, F.col("pos") + 1, F.col("stop") - F.col("pos"))).otherwise(
        F.regexp_extract(F.substring(body, F.col("pos") + 1, F.length(body) - F.col("pos")), r"\A[^\n]*", 0)
    )
    bodies = _delivered(files).groupBy(*DELIVERY).agg(F.any_value("body").alias("body"))
    return docs.join(bodies, DELIVERY).select("file_id", F.col("line").alias("line_no"), "element_name", "doc", code.alias("code"))
