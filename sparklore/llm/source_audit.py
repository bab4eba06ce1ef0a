"""Operator 11: how far the sources of a language diverge in their terms, by count-level bitmaps.

For each group (language, source) and each count, the terms that the group has just that often are a set of bits,
64 terms to a word. Terms are numbered by falling frequency, so the terms of a word have few different counts.
Two groups' words of the same terms are joined, and the population count of their AND is the number of terms that
one group has c times and the other d times: a joint cell, which f(c, d) is multiplied by. Cells with a zero need no
bits of their own: what the other group has c times and no joint cell holds is their complement,

    sum of f = V f(0,0) + sum_c |c| (f(c,0) - f(0,0)) + sum_d |d| (f(0,d) - f(0,0))
               + sum_cd |c and d| (f(c,d) - f(c,0) - f(0,d) + f(0,0)).

All arithmetic is of whole numbers.
"""

from __future__ import annotations

from collections import defaultdict

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import small_batches, stored

#: Entries (group, term) that a task counts together before it sends them on.
HELD = 400_000
#: All bytes but those of terms become spaces; A-Z become a-z.
_FOLDED = bytes(c + 32 if 0x41 <= c <= 0x5A else c if 0x61 <= c <= 0x7A or c >= 0x80 else 0x20 for c in range(256))


def term_counts(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """(lang, source, term, n, docs): occurrences and documents of each term in each group; a row without a term for each group.

    Rows may come in parts, which are to be summed: a task sends on what it has counted whenever that is ``HELD`` entries.
    """
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    rows = docs.select(text(lang_col).alias("lang"), text(source_col).alias("source"), text(text_col).cast("binary").alias("text"))
    small_batches(docs.sparkSession)

    def run(batches):
        held, size = defaultdict(dict), 0

        def sent():
            for (lang, source), counts in held.items():
                names = pa.array([None, *counts], pa.binary())
                n, d = [0], [0]
                for x, y in counts.values():
                    n.append(x)
                    d.append(y)
                columns = [pa.repeat(pa.scalar(v), len(names)) for v in (lang, source)]
                yield pa.RecordBatch.from_arrays([*columns, names, pa.array(n, pa.int64()), pa.array(d, pa.int64())], names=["lang", "source", "term", "n", "docs"])

        for batch in batches:
            for lang, source, text_ in zip(*(batch.column(c).to_pylist() for c in range(3))):
                counts, own = held[lang, source], {}
                before = len(counts)
                for term in text_.translate(_FOLDED).split(b" "):
                    own[term] = own.get(term, 0) + 1
                own.pop(b"", None)
                for term, n in own.items():
                    known = counts.get(term)
                    if known is None:
                        counts[term] = [n, 1]
                    else:
                        known[0] += n
                        known[1] += 1
                size += len(counts) - before
            if size > HELD:
                yield from sent()
                held, size = defaultdict(dict), 0
        yield from sent()

    out = rows.mapInArrow(run, "lang string, source string, term binary, n long, docs long")
    return out.withColumn("term", F.col("term").cast("string"))


def share(count: Column, total: Column, kept: Column) -> Column:
    """1 + floor(1000000000 (count + 2) / (total + 2 kept)); as decimals, as the product may exceed a long."""
    upper = F.lit(1_000_000_000).cast("decimal(10,0)") * (count + 2).cast("decimal(20,0)")
    return 1 + F.call_function("div", upper, (total + 2 * kept).cast("decimal(20,0)"))


def divergence(p: Column, q: Column) -> Column:
    """floor((p - q)^2 / (p + q)) of two shares."""
    return F.call_function("div", (p - q) * (p - q), p + q)


def count_levels(counts: DataFrame, terms: DataFrame) -> DataFrame:
    """(lang, word, source, n, bits): the terms of a word of 64 numbers that the group has ``n`` > 0 times, as bits.

    ``terms`` (lang, term, n) are the kept ones; their numbers follow each other by falling frequency and may pass
    from one language to the next, and from one partition to the next with a gap.
    """
    numbered = terms.repartitionByRange("lang", F.desc("n"), "term").sortWithinPartitions("lang", F.desc("n"), "term")
    numbered = stored(numbered.select("lang", "term", F.monotonically_increasing_id().alias("number")), "audit_numbers")
    bit = F.expr("shiftleft(1L, cast(number % 64 as int))")
    return counts.where("n > 0").join(numbered, ["lang", "term"]).groupBy("lang", F.shiftright("number", 6).alias("word"), "source", "n").agg(F.bit_or(bit).alias("bits"))


def pair_divergence(levels: DataFrame, groups: DataFrame) -> DataFrame:
    """(lang, source, other, value) for every two groups of a language, in both orders; ``groups`` has the totals and kept terms."""
    groups = groups.select("lang", "source", "total", "kept", F.when(F.col("kept") > 0, share(F.lit(0), F.col("total"), F.col("kept"))).alias("zero"))
    sided = lambda df, side, *same: df.select(*same, *(F.col(c).alias(f"{c}_{side}") for c in df.columns if c not in same))
    p = share(F.col("n"), F.col("total"), F.col("kept"))
    marked = levels.join(groups, ["lang", "source"]).select("lang", "word", "source", "bits", "zero", p.alias("p"))
    a, b = sided(marked, "a", "lang", "word"), sided(marked, "b", "lang", "word")
    cell = F.bit_count(F.col("bits_a").bitwiseAND(F.col("bits_b"))).cast("long")
    beyond = divergence(F.col("p_a"), F.col("p_b")) - divergence(F.col("p_a"), F.col("zero_b")) - divergence(F.col("zero_a"), F.col("p_b")) + divergence(F.col("zero_a"), F.col("zero_b"))
    joint = a.join(b, ["lang", "word"]).where("source_a < source_b and bits_a & bits_b <> 0").groupBy("lang", "source_a", "source_b").agg(F.sum(cell * beyond).alias("joint"))
    joint = stored(joint, "audit_joint")
    joint = joint.union(joint.select("lang", "source_b", "source_a", "joint")).toDF("lang", "source", "other", "joint")

    # Of each group's terms that a count stands for, as if the other group had none of them.
    sizes = marked.groupBy("lang", "source", "p").agg(F.sum(F.bit_count("bits").cast("long")).alias("size"))
    other = groups.select("lang", F.col("source").alias("other"), F.col("zero").alias("zero_other"))
    zero = divergence(F.col("zero"), F.col("zero_other"))
    single = sizes.join(groups.select("lang", "source", "zero"), ["lang", "source"]).join(other, "lang").where("source <> other")
    single = stored(single.groupBy("lang", "source", "other").agg(F.sum(F.col("size") * (divergence(F.col("p"), F.col("zero_other")) - zero)).alias("single")), "audit_single")
    every = groups.join(other, "lang").where("source <> other").withColumn("none", F.coalesce(F.col("kept") * zero, F.lit(0)))
    keys = ["lang", "source", "other"]
    out = every.join(single, keys, "left").join(single.select("lang", F.col("source").alias("other"), F.col("other").alias("source"), F.col("single").alias("reverse")), keys, "left").join(joint, keys, "left")
    return out.select(*keys, sum((F.coalesce(c, F.lit(0)) for c in ("single", "reverse", "joint")), F.col("none")).cast("long").alias("value"))


def audit(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", source_col: str = "source", least_docs: int = 10, top: int = 10) -> DataFrame:
    """(lang, source, part, item, value, rank).

    Part ``pair`` has, for every two sources of a language, the sum over its kept terms (those of at least
    ``least_docs`` of its documents) of ``divergence`` between the sources' shares; part ``term`` the ``top`` terms that
    a source has more often than its language. Ranks are by falling value, then by the item's UTF-8 bytes.
    Null texts, languages and sources count as empty ones. Rows that repeat count each; a group whose documents have
    no term takes part in pairs, as does one of a language without kept terms, with 0. Columns besides the three
    are ignored; empty in, empty out.
    """
    parts = term_counts(docs, text_col, lang_col, source_col)
    counts = stored(parts.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs")), "audit_counts")
    terms = counts.where("term is not null").groupBy("lang", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs")).where(F.col("docs") >= least_docs)
    terms = stored(terms.select("lang", "term", "n"), "audit_terms")
    kept = stored(counts.join(terms.select("lang", "term"), ["lang", "term"]).select("lang", "source", "term", "n"), "audit_kept")
    of_lang = terms.groupBy("lang").agg(F.count("*").alias("kept"), F.sum("n").alias("lang_total"))
    totals = kept.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    groups = counts.where("term is null").select("lang", "source").join(of_lang, "lang", "left").join(totals, ["lang", "source"], "left")
    groups = stored(groups.select("lang", "source", *(F.coalesce(c, F.lit(0).cast("long")).alias(c) for c in ("kept", "lang_total", "total"))), "audit_groups")

    levels = stored(count_levels(kept, terms), "audit_levels")
    pairs = pair_divergence(levels, groups).withColumnRenamed("other", "item")
    p, q = share(F.col("n"), F.col("total"), F.col("kept")), share(F.col("all"), F.col("lang_total"), F.col("kept"))
    own = kept.join(terms.withColumnRenamed("n", "all"), ["lang", "term"]).join(groups, ["lang", "source"]).withColumn("p", p).withColumn("q", q).where("p > q")
    own = own.select("lang", "source", F.col("term").alias("item"), divergence(F.col("p"), F.col("q")).alias("value"))
    rank = F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item"))
    ranked = pairs.withColumn("part", F.lit("pair")).withColumn("rank", rank).unionByName(own.withColumn("part", F.lit("term")).withColumn("rank", rank).where(F.col("rank") <= top))
    return ranked.select("lang", "source", "part", "item", "value", "rank")


ORACLE = """
with d as (select row_number() over () as doc, coalesce(lang, '') as lang, coalesce(source, '') as source,
  regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x40\\x5B-\\x60\\x7B-\\x7F]+') as terms from documents),
t as (select doc, lang, source, unnest(terms) as term from d),
k as (select lang, term, count(*) as a from t group by 1, 2 having count(distinct doc) >= 10),
l as (select lang, count(*) as v, sum(a) as na from k group by 1),
g as (select distinct lang, source from d),
c as (select lang, source, term, count(*) as n from t join k using (lang, term) group by 1, 2, 3),
s as (select lang, source, sum(n) as total from c group by 1, 2),
x as (select g.lang, g.source, k.term, coalesce(c.n, 0) as n, 1 + (1000000000::hugeint * (coalesce(c.n, 0) + 2)) // (coalesce(s.total, 0) + 2 * l.v) as p,
    1 + (1000000000::hugeint * (k.a + 2)) // (l.na + 2 * l.v) as q
  from g join k on k.lang = g.lang join l on l.lang = g.lang left join c on c.lang = g.lang and c.source = g.source and c.term = k.term left join s on s.lang = g.lang and s.source = g.source),
f as (select a.lang, a.source, b.source as item, sum(((a.p - b.p) * (a.p - b.p)) // (a.p + b.p)) as value from x a join x b on a.lang = b.lang and a.term = b.term and a.source <> b.source group by 1, 2, 3),
w as (select a.lang, a.source, 'pair' as part, b.source as item, coalesce(f.value, 0)::bigint as value from g a join g b on a.lang = b.lang and a.source <> b.source left join f on f.lang = a.lang and f.source = a.source and f.item = b.source
  union all select lang, source, 'term', term, (((p - q) * (p - q)) // (p + q))::bigint from x where n > 0 and p > q),
r as (select *, (row_number() over (partition by lang, source, part order by value desc, item))::int as rank from w)
select lang, source, part, item, value, rank from r where part = 'pair' or rank <= 10"""
