"""Questions matched to documents by file name, and questions about which documents there are."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import files
from ..functions.text import normalize
from . import topk

# Words of a question that name no document.
STOP_WORDS = "a about any ask can called did do document documents docs file files for from have has i in is it list me my named of open please see show summarize summary tell the there this titled uploaded what which with workspace".split()
KIND_WORDS = "md markdown pdf docx xlsx xls csv txt text spreadsheet spreadsheets".split()
ASKED_KINDS = {"markdown": "md markdown", "pdf": "pdf", "docx": "docx", "xlsx": "xlsx xls excel workbook spreadsheet spreadsheets", "csv": "csv spreadsheet spreadsheets", "text": "txt text"}
#: What each sign that a question means a document counts.
POINTS = {"name": 120, "base": 100, "every term": 45, "kind": 35, "kind alone": 20, "term": 18, "other kind": -20}
CLASSES = {"exact": 5, "strong": 4, "wrong_extension": 3, "near": 2, "kind_only": 1, "none": 0}


def plain(text: Column) -> Column:
    return normalize(F.regexp_replace(text, "&", " and "))


def _words(text: Column) -> Column:
    return F.filter(F.split(text, " "), lambda w: w != "")


def asked_kinds(text: Column) -> Column:
    words = _words(plain(text))
    return F.array_compact(F.array(*[F.when(F.arrays_overlap(words, F.array(*[F.lit(w) for w in names.split()])), F.lit(kind)) for kind, names in ASKED_KINDS.items()]))


def asked_terms(text: Column) -> Column:
    return F.array_distinct(F.filter(_words(plain(text)), lambda w: (F.length(w) > 1) & ~w.isin(STOP_WORDS + KIND_WORDS) & ~F.array_contains(asked_kinds(text), w)))


#: Characters of the pieces of words by which questions and names meet.
PIECE = 4


def _pieces(text: Column, size: int = PIECE) -> Column:
    """All pieces of a text, each once; a shorter text is its own piece."""
    last = F.greatest(F.length(text) - (size - 1), F.lit(1))
    return F.array_distinct(F.transform(F.sequence(F.lit(1), last), lambda i: F.substring(text, i, F.lit(size))))


def name_index(documents: DataFrame, scope: list[str]) -> DataFrame:
    """scope, document_id, key: by what a document's name can be found. Written once, it serves any number of questions.

    w: a word's beginning, or all of a shorter word, for a question's word that holds it; p: each piece of a word, for a
    question's word that it holds; n: the beginning of the name without its ending, for a question that holds it whole.
    """
    base, name = plain(files.base(F.col("filename"))), plain(F.col("filename"))
    parts = F.array_distinct(F.concat(_words(base), _words(name)))
    tagged = lambda tag, of: F.transform(of, lambda x: F.concat(F.lit(tag), x))
    keys = F.concat(
        tagged("w", F.transform(parts, lambda x: F.substring(x, 1, PIECE))),
        tagged("p", F.flatten(F.transform(parts, lambda x: _pieces(x)))),
        tagged("n", F.filter(F.array(F.substring(base, 1, PIECE), F.substring(name, 1, PIECE)), lambda x: x != "")),
    )
    return documents.select(*scope, "document_id", F.explode(F.array_distinct(keys)).alias("key"))


def _candidates(questions: DataFrame, documents: DataFrame, scope: list[str], index: DataFrame | None) -> DataFrame:
    """query_id, scope, document_id of the pairs that can match: by names' pieces, or by kind alone for questions without terms.

    A question's word and a name's match if they are equal or one holds the other, of which it is the longer part that has
    a piece of the shorter's beginning; a name that a question holds whole has its beginning in the question.
    """
    said = plain(F.col("question"))
    terms = asked_terms(F.col("question"))
    tagged = lambda tag, of: F.transform(of, lambda x: F.concat(F.lit(tag), x))
    whole = F.flatten(F.array(*[_pieces(said, n) for n in range(1, PIECE + 1)]))
    keys = F.concat(
        tagged("w", F.flatten(F.transform(terms, lambda t: F.array_union(_pieces(t), F.array(F.substring(t, 1, PIECE)))))),
        tagged("p", F.transform(terms, lambda t: F.substring(t, 1, PIECE))),
        tagged("n", whole),
    )
    asked = questions.select("query_id", *scope, F.explode(F.array_distinct(keys)).alias("key"))
    own = name_index(documents, scope) if index is None else index
    named = asked.join(own, [*scope, "key"]).select("query_id", *scope, "document_id")
    kinds = questions.where(F.size(terms) == 0).select("query_id", *scope, F.explode(asked_kinds(F.col("question"))).alias("_kind"))
    of_kind = documents.select(*scope, "document_id", files.kind(F.col("filename")).alias("_kind"))
    alone = kinds.join(of_kind, [*scope, "_kind"]).select("query_id", *scope, "document_id")  # each of these is a row of the result
    return named.unionByName(alone).distinct()


def match_documents(questions: DataFrame, documents: DataFrame, scope: list[str], index: DataFrame | None = None) -> DataFrame:
    """query_id, document_id, filename, score, match_class, is_best: each document in scope that a question may mean.

    questions: query_id, question; documents: document_id, filename; index: name_index(documents, scope), if it is stored.
    Both are prepared once a row, and only pairs that share a piece of a name, or that a kind alone brings together, are
    looked at. query_id and document_id tell rows of a scope apart.
    """
    q = questions.select("query_id", *scope, plain(F.col("question")).alias("_said"), asked_kinds(F.col("question")).alias("_kinds"), asked_terms(F.col("question")).alias("_terms"))
    d = documents.select(*scope, "document_id", "filename", plain(F.col("filename")).alias("_name"), plain(files.base(F.col("filename"))).alias("_base"), files.kind(F.col("filename")).alias("_kind"))
    d = d.withColumn("_parts", F.array_distinct(F.concat(_words(F.col("_base")), _words(F.col("_name")))))
    pairs = _candidates(questions, documents, scope, index)
    near = lambda a, b: (a == b) | ((F.length(a) >= 4) & F.contains(b, a)) | ((F.length(b) >= 4) & F.contains(a, b))
    p = pairs.join(d, [*scope, "document_id"]).join(q, ["query_id", *scope]).select(
        "query_id", "document_id", "filename", "_terms", "_kinds",
        ((F.col("_name") != "") & F.contains("_said", "_name")).alias("_exact"),
        ((F.col("_base") != "") & F.contains("_said", "_base")).alias("_has_base"),
        F.size(F.filter("_terms", lambda t: F.exists("_parts", lambda x: near(t, x)))).alias("_n"),
        F.coalesce(F.array_contains("_kinds", F.col("_kind")), F.lit(False)).alias("_asked_kind"),
    )
    some, kinds, every = F.size("_terms") > 0, F.size("_kinds") > 0, F.col("_n") == F.size("_terms")
    points = lambda when, what: F.when(when, POINTS[what]).otherwise(0)
    of_kind = F.when(F.col("_asked_kind"), POINTS["kind"]).when(kinds, POINTS["other kind"]).otherwise(0)
    score = points(F.col("_exact"), "name") + points(F.col("_has_base"), "base") + POINTS["term"] * F.col("_n") + points(some & every, "every term") + of_kind + points(~some & F.col("_asked_kind"), "kind alone")
    fits = ~kinds | F.col("_asked_kind")
    found = (
        F.when(F.col("_exact"), "exact")
        .when(some & fits & (F.col("_has_base") | every), "strong")
        .when(~some & F.col("_asked_kind"), "kind_only")
        .when(some & kinds & ~fits & (F.col("_n") > 0), "wrong_extension")
        .when(some & (F.col("_n") > 0), "near")
        .otherwise("none")
    )
    matched = p.select("query_id", "document_id", "filename", score.alias("score"), found.alias("match_class")).where("match_class <> 'none'")
    order = reduce(lambda x, c: x.when(F.col("match_class") == c, CLASSES[c]), CLASSES, F)
    best = Window.partitionBy("query_id").orderBy(F.desc(order), F.desc("score"), "filename", "document_id")
    return matched.withColumn("is_best", F.row_number().over(best) == 1)


# Questions that ask which documents there are, and whether there is one.
INVENTORY = (
    r"\b(?:what|which)\s+(?:files|documents|uploads)\b.*\b(?:uploaded|in (?:this|the) workspace|available)\b",
    r"\b(?:list|show)\s+(?:my\s+)?(?:files|documents|uploads)\b",
    r"\b(files|documents)\b.*\b(uploaded|in this workspace)\b",
)
EXISTENCE = (
    r"\b(do i have|did i upload|is there|are there|do you see|does .*exist|exists|available)\b",
    r"\b(any|a|an)\s+(?:uploaded\s+)?(?:file|document|spreadsheet|pdf|docx|md|markdown|csv|xlsx|xls|txt)\b",
)
KIND_NAMES = {"csv": "CSV file", "docx": "DOCX file", "markdown": "Markdown `.md` file", "pdf": "PDF", "text": "text file", "xlsx": "spreadsheet"}
NO_DOCUMENTS = "I do not see any uploaded documents in this workspace yet."
FOUND, UPLOADED, IN_WORKSPACE, MORE = "I found ", " uploaded ", " in this workspace:\n\n", ("\n\nThere are ", " more documents in this workspace.")
MATCHING, THAT_NAME, YES, END = " matching ", " matching that name", "Yes. I found ", "."
SIMILAR_TITLE, BUT_NO, BUT_NONE = "I found a similar document title, ", ", but I do not see a ", ", but I do not see one"
INCLUDING, SIMILAR, OF_THAT_NAME = "s in this workspace, including ", "I found a similar document, ", " matching that name."
NOT_SEEN, NO_FILE, HERE = "I do not see a ", "matching file", " in this workspace."
VISIBLE, VISIBLE_OF_KIND, NAMED_OF_KIND = 12, 8, 3


def asks_inventory(text: Column) -> Column:
    return reduce(lambda x, y: x | y, [plain(text).rlike(p) for p in INVENTORY])


def asks_existence(text: Column) -> Column:
    return reduce(lambda x, y: x | y, [plain(text).rlike(p) for p in EXISTENCE])


def _newest(documents: DataFrame, by: list[str], most: int) -> DataFrame:
    """by, n, names: how many documents there are and the names of the newest, of which each task keeps no more than most."""
    n = documents.groupBy(*by).agg(F.count("*").alias("n"))
    top = topk.per_group(documents.select(*by, "document_id", "filename"), by, [F.desc("document_id")], most, "place")
    names = top.groupBy(*by).agg(F.transform(F.sort_array(F.collect_list(F.struct("place", "filename"))), lambda x: x["filename"]).alias("names"))
    return n.join(names, by)


def _list(names: Column) -> Column:
    return F.array_join(F.transform(names, lambda x: F.concat(F.lit("- "), x)), "\n")


def inventory_answer(questions: DataFrame, documents: DataFrame, scope: list[str], visible: int = VISIBLE) -> DataFrame:
    """query_id, answer for questions that ask which documents there are: the newest, so many lines, and how many more."""
    lines = _newest(documents, scope, visible)
    n = F.col("n")
    more = F.when(n > visible, F.concat(F.lit(MORE[0]), (n - visible).cast("string"), F.lit(MORE[1]))).otherwise("")
    noun = F.when(n == 1, "document").otherwise("documents")
    answer = F.when(n.isNull(), NO_DOCUMENTS).otherwise(F.concat(F.lit(FOUND), n.cast("string"), F.lit(UPLOADED), noun, F.lit(IN_WORKSPACE), _list(F.col("names")), more))
    return questions.where(asks_inventory(F.col("question"))).join(lines, scope, "left").select("query_id", answer.alias("answer"))


def existence_answer(questions: DataFrame, documents: DataFrame, scope: list[str]) -> DataFrame:
    """query_id, answer for questions that ask whether there is a document: the one that is meant, the ones of its kind, or one like it.

    questions: query_id, question, scope; documents: document_id, filename, scope. What a question may mean comes from
    match_documents; of the documents of a kind only a count and the newest names are joined.
    """
    asked = questions.where(asks_existence(F.col("question")) & ~asks_inventory(F.col("question")))
    order = F.struct((-F.col("score")).alias("s"), "filename", "document_id")
    first = match_documents(asked, documents, scope).groupBy("query_id").agg(*[F.min(F.when(F.col("match_class") == c, order))["filename"].alias(c) for c in ("exact", "strong", "wrong_extension", "near")])
    kinds = _newest(documents.withColumn("kind", files.kind(F.col("filename"))).where("kind is not null"), [*scope, "kind"], VISIBLE_OF_KIND)
    wanted = asked.select("query_id", *scope, F.explode(asked_kinds(F.col("question"))).alias("kind"))
    of_kinds = wanted.join(kinds, [*scope, "kind"]).groupBy("query_id").agg(F.sum("n").alias("n"), F.flatten(F.transform(F.sort_array(F.collect_list(F.struct("kind", "names"))), lambda x: x["names"])).alias("names"))
    some = documents.select(*scope).distinct().withColumn("has_documents", F.lit(True))
    prepared = asked.select("query_id", *scope, asked_kinds(F.col("question")).alias("kinds"), asked_terms(F.col("question")).alias("terms"))
    p = prepared.join(first, "query_id", "left").join(of_kinds, "query_id", "left").join(some, scope, "left")
    names = F.create_map(*[F.lit(x) for pair in KIND_NAMES.items() for x in pair])
    kind = F.when(F.array_sort("kinds") == F.array(F.lit("csv"), F.lit("xlsx")), "spreadsheet").otherwise(F.array_join(F.transform("kinds", lambda k: names[k]), " or "))
    target, has_terms, n = F.array_join("terms", " "), F.size("terms") > 0, F.coalesce("n", F.lit(0))
    meant = F.when(has_terms, F.concat(F.lit(f"{MATCHING}'"), target, F.lit("'"))).otherwise(THAT_NAME)
    tick = lambda x: F.concat(F.lit("`"), x, F.lit("`"))
    found = F.concat(F.lit(FOUND), n.cast("string"), F.lit(MATCHING), F.when(n == 1, "file").otherwise("files"), F.lit(":\n\n"), _list(F.slice(F.coalesce("names", F.array().cast("array<string>")), 1, VISIBLE_OF_KIND)))
    missing = F.trim(F.concat(F.when(F.size("kinds") == 1, F.replace(names[F.element_at("kinds", 1)], F.lit(" `.md`"), F.lit(""))).otherwise(""), F.when(has_terms, F.concat(F.lit(MATCHING), tick(target))).otherwise("")))
    answer = (
        F.when(F.col("has_documents").isNull(), NO_DOCUMENTS)
        .when(F.coalesce("exact", "strong").isNotNull(), F.concat(F.lit(YES), tick(F.coalesce("exact", "strong")), F.lit(END)))
        .when(~has_terms & (n > 0), found)
        .when(F.col("wrong_extension").isNotNull() & (F.size("kinds") > 0), F.concat(F.lit(SIMILAR_TITLE), tick(F.col("wrong_extension")), F.lit(BUT_NO), kind, meant, F.lit(END)))
        .when(n > 0, F.concat(F.lit(FOUND), kind, F.lit(INCLUDING), F.array_join(F.transform(F.slice("names", 1, NAMED_OF_KIND), tick), ", "), F.lit(BUT_NONE), meant, F.lit(END)))
        .when(F.col("near").isNotNull() & (F.size("kinds") > 0), F.concat(F.lit(SIMILAR), tick(F.col("near")), F.lit(BUT_NO), kind, F.lit(OF_THAT_NAME)))
        .otherwise(F.concat(F.lit(NOT_SEEN), F.when(missing == "", NO_FILE).otherwise(missing), F.lit(HERE)))
    )
    return p.select("query_id", answer.alias("answer"))
