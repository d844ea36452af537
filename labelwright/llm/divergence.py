"""Source divergence audit: how far the sources of a language differ in their terms, by a baseline-corrected inverted index.

Term counts of a slice of text are made by arrays and summed by Spark. Of each language the terms in at least LEAST documents
are kept; their V rows are the index: a term's postings are the groups (lang, source) that have it, with their counts. f of
two probabilities that both stand for a zero count is the same for all terms, so each pair of groups starts at V times that
baseline, and only nonzero corrections follow:

- a group's terms compared with another group's zero: terms of one count have one p, so a group gives a row for each
  distinct count, not for each term;
- terms that both groups have: a posting list gives its pairs, which are summed in each task before they are shuffled.

All of it is integer arithmetic, 64-bit or decimal.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import base, terms

LEAST, SCALE, TOP = 10, 1_000_000_000, 10
TABLE = terms.byte_table(terms.LETTERS)


def term_counts(docs: DataFrame) -> DataFrame:
    """(lang, source, term, n, docs): occurrences and documents of each term; each group also has a row of the term '', of zeros.

    Each row of (text, lang, source) is a document, nulls are ''; other columns are ignored.
    """
    own = docs.select(*[F.coalesce(F.col(f"`{c}`"), F.lit("")).alias(c) for c in ("text", "lang", "source")])

    def run(batch):
        groups = pa.table({"lang": batch.column(1), "source": batch.column(2)})
        named = groups.append_column("row", pa.array(range(len(groups)))).group_by(["lang", "source"]).aggregate([("row", "list")]).combine_chunks()
        rows = pa.concat_arrays(named["row_list"].chunks)
        group_of = rows.value_parent_indices().take(pa.array(rows.flatten().to_numpy().argsort()))
        yield _rows(named, pa.array(range(len(named))), pa.array([""] * len(named)), pa.array([0] * len(named)), pa.array([0] * len(named)))
        parts = []
        for row, term, n, names in terms.counts(batch.column(0), TABLE):
            found = pa.table({"group": group_of.take(pa.array(row)), "term": term, "n": n}).group_by(["group", "term"]).aggregate([("n", "sum"), ("n", "count")])
            words = names.take(found["term"].combine_chunks())
            parts.append(pa.table({"group": found["group"], "term": words, "n": found["n_sum"], "docs": found["n_count"]}))
        found = pa.concat_tables(parts).group_by(["group", "term"]).aggregate([("n", "sum"), ("docs", "sum")])  # a batch's slices share most terms
        if len(found):
            yield _rows(named, found["group"], found["term"], found["n_sum"], found["docs_sum"])

    sums = [F.sum("n").alias("n"), F.sum("docs").alias("docs")]
    return base.mapped(own, run, "lang string, source string, term string, n long, docs long").groupBy("lang", "source", "term").agg(*sums)


def _rows(named: pa.Table, group, term, n, docs) -> pa.RecordBatch:
    own = named.select(["lang", "source"]).take(group)
    return pa.table({"lang": own["lang"], "source": own["source"], "term": term, "n": n, "docs": docs}).combine_chunks().to_batches()[0]


def difference(p: Column, q: Column) -> Column:
    """f of two probabilities."""
    return F.call_function("div", (p - q) * (p - q), p + q)


def probability(n: Column, total: Column, kept: Column) -> Column:
    """p of a count; null where no term is kept."""
    return F.call_function("div", (n + 2).cast("decimal(20,0)") * F.lit(SCALE).cast("decimal(10,0)"), (total + 2 * kept).cast("decimal(20,0)")) + 1


class Audit:
    """The tables of an audit, each written once; close() deletes them."""

    def __init__(self, docs: DataFrame, least: int = LEAST):
        counts = base.written(term_counts(docs), "term_counts")
        named = counts.where("term = ''").select("lang", "source", F.monotonically_increasing_id().alias("g"))
        named = base.written(named, "audit_groups")
        posting = F.collect_list(F.when(F.col("n") > 0, F.struct("g", "n"))).alias("postings")
        lists = counts.where("term <> ''").join(named, ["lang", "source"]).groupBy("lang", "term").agg(F.sum("docs").alias("docs"), F.sum("n").alias("n"), posting)
        #: (lang, term, n, postings): the kept terms with their groups' numbers and counts.
        self.index = base.written(lists.where(F.col("docs") >= least).drop("docs"), "term_index")
        langs = self.index.groupBy("lang").agg(F.count("*").alias("v"), F.sum("n").alias("lang_total"))
        totals = self.index.select(F.explode("postings").alias("p")).groupBy("p.g").agg(F.sum("p.n").alias("total"))
        zero = probability(F.lit(0), F.col("total"), F.col("v")).alias("zero")
        groups = named.join(langs, "lang", "left").join(totals, "g", "left").na.fill(0, ["v", "lang_total", "total"])
        #: (g, lang, source, v, total, lang_total, zero): zero is p of a zero count.
        self.groups = base.written(groups.select("g", "lang", "source", "v", "total", "lang_total", F.when(F.col("v") > 0, zero).alias("zero")), "audit_totals")
        self._tables = (counts, named, self.index, self.groups)

    def entries(self) -> DataFrame:
        """(g, lang, term, n, p, zero, lang_n): a row for each kept term of each group that has it."""
        own = self.index.select("term", F.col("n").alias("lang_n"), F.explode("postings").alias("x")).select("term", "lang_n", "x.g", "x.n")
        return own.join(self.groups, "g").withColumn("p", probability(F.col("n"), F.col("total"), F.col("v")))

    def pairs(self) -> DataFrame:
        """(lang, source, item, value): every ordered pair of two sources of a language."""
        a, b = F.col("a"), F.col("b")
        sides = self.groups.select("lang", "v", F.struct("g", "source", "zero").alias("a")).join(self.groups.select("lang", F.struct("g", "source", "zero").alias("b")), "lang")
        sides = sides.where(a["g"] < b["g"])
        own = self.entries().groupBy("lang", "g", "zero", "p").agg(F.count("*").alias("times"))  # terms of one count
        others = self.groups.select("lang", F.col("g").alias("other"), F.col("zero").alias("other_zero"))
        one = own.join(others, "lang").where("g <> other").groupBy(F.least("g", "other").alias("ga"), F.greatest("g", "other").alias("gb")).agg(
            F.sum(F.col("times") * (difference(F.col("p"), F.col("other_zero")) - difference(F.col("zero"), F.col("other_zero")))).alias("one")
        )
        both = self._shared().groupBy("ga", "gb").agg(F.sum("correction").alias("both"))
        baseline = F.coalesce(F.col("v") * difference(a["zero"], b["zero"]), F.lit(0))
        found = sides.select("*", a["g"].alias("ga"), b["g"].alias("gb")).join(one, ["ga", "gb"], "left").join(both, ["ga", "gb"], "left")
        found = found.select("lang", a["source"].alias("x"), b["source"].alias("y"), (baseline + F.coalesce("one", F.lit(0)) + F.coalesce("both", F.lit(0))).alias("value"))
        turned = F.explode(F.array(F.struct(F.col("x").alias("source"), F.col("y").alias("item")), F.struct(F.col("y").alias("source"), F.col("x").alias("item")))).alias("s")
        return found.select("lang", turned, "value").select("lang", "s.source", "s.item", "value")

    def _shared(self) -> DataFrame:
        """(ga, gb, correction): for each kept term and each two groups that have it, what the two one-sided corrections leave out."""
        entry = F.struct("g", "p", "zero")
        lists = self.entries().groupBy("lang", "term").agg(F.sort_array(F.collect_list(entry)).alias("e"))
        first = lists.select("e", F.posexplode("e").alias("i", "a"))
        both = first.select("a", F.explode(F.slice("e", F.col("i") + 2, F.size("e"))).alias("b"))
        a, b = F.col("a"), F.col("b")
        value = difference(a["p"], b["p"]) - difference(a["p"], b["zero"]) - difference(a["zero"], b["p"]) + difference(a["zero"], b["zero"])
        return both.select(a["g"].alias("ga"), b["g"].alias("gb"), value.alias("correction"))

    def leading_terms(self, most: int = TOP) -> DataFrame:
        """(lang, source, item, value, rank): of each group the terms that it has oftener than its language, the `most` of highest f."""
        q = probability(F.col("lang_n"), F.col("lang_total"), F.col("v"))
        found = self.entries().withColumn("q", q).where("p > q").select("lang", "source", F.col("term").alias("item"), difference(F.col("p"), F.col("q")).alias("value"))
        return ranked(found).where(F.col("rank") <= most)

    def close(self) -> None:
        base.release(*self._tables)


def ranked(found: DataFrame) -> DataFrame:
    return found.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")))


def audited(docs: DataFrame, least: int = LEAST, most: int = TOP) -> DataFrame:
    """(lang, source, part, item, value, rank) of documents (text, lang, source).

    Part `pair`: each other source of the language by descending divergence; part `term`: the group's leading terms. A group
    without terms still has its pairs; where a language keeps no term all values are 0. Ties go by the item's bytes. Each row
    is a document, repeated or not; null text, lang and source are '' and join the groups of ''. No rows give none.
    """
    audit = Audit(docs, least)
    pairs = ranked(audit.pairs()).select("lang", "source", F.lit("pair").alias("part"), "item", "value", "rank")
    return pairs.unionByName(audit.leading_terms(most).withColumn("part", F.lit("term")))
