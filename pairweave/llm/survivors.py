"""Best representative of each duplicate group: one surviving record, chosen field by field."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pairweave.sources.tables import table


@dataclass(frozen=True)
class FieldRule:
    """Which values of a field count, as an inclusive range, and how they are normalised before votes add up."""

    low: float
    high: float

    def usable(self, value: Column) -> Column:
        return value.between(self.low, self.high)

    def normalise(self, value: Column) -> Column:
        return value.cast("long")


def plain_name(name: Column) -> Column:
    """Letters and digits of a name, in lower case; null if there are none."""
    plain = F.regexp_replace(F.lower(name), "[^\\p{L}\\p{N}]", "")
    return F.when(plain != "", plain)


def field_winners(records: DataFrame, members: DataFrame, trust: DataFrame, rules: Mapping[str, FieldRule], *, rule: str = "order", half_life_days: float = 30.0) -> DataFrame:
    """One row per group with the winning record and value of every field.

    ``records`` has ``rec_id, id, provider, updated_at`` and the fields, ``members`` has ``id, group`` (any number of
    ids per group, one group per id), ``trust`` has ``provider, trust_rank``. The result has ``group, n_records``
    and, per field f, ``f_rec`` (0 if no record has a usable value), ``f_value`` and ``f_votes``.

    Fields are unpivoted to long rows, one vote per usable value. A vote weighs the source's trust times a recency
    decay; the votes of a normalised value are summed, the value with the highest sum wins by max_by, and winners are
    pivoted back. ``rule`` says how steep the weights are:

    * ``votes``: trust is 1 / rank (unknown sources count 1 / 65,536), recency is halved every ``half_life_days``
      (a null date has none). Sums are doubles; a vote more than 1,000 half-lives before the newest record weighs 0.
      Equal sums, to nine digits of their logarithm, go by the order below.
    * ``order``: weights so steep that no number of lesser votes outweighs a greater one. Such a sum is a number
      whose digits, from the highest on, count the votes of each (trust, date, record), so it compares by its leading
      digit: lowest rank, then latest date (null last), then smallest rec_id, which no two values share. The leading
      digit of a sum is the largest of its votes, and so is added up by max, without overflow.

    Votes are summed per object and then per group, each before its shuffle, so neither a record-rich object nor a
    large group ever meets in one task. Objects without records, records without a group, null ids and null groups
    drop out; repeated rows of ``members`` count once, repeated records each. Other columns, whatever their names, are
    ignored. An empty table gives an empty result.
    """
    if rule not in ("order", "votes"):
        raise ValueError("rule must be 'order' or 'votes'")
    ranks = trust.select(plain_name(F.col("provider")).alias("_p"), "trust_rank").filter("_p is not null").groupBy("_p").agg(F.min("trust_rank").alias("rank"))
    records = records.select("rec_id", "id", "updated_at", plain_name(F.col("provider")).alias("_p"), *rules).filter("id is not null")
    named = records.join(ranks, "_p", "left")
    digit = F.struct((-F.coalesce("rank", F.lit(1 << 30))).alias("trust"), F.unix_micros(F.col("updated_at").cast("timestamp")).alias("at"), (-F.col("rec_id")).alias("neg_id"))
    if rule == "votes":
        newest = F.lit(records.agg(F.max(F.unix_micros(F.col("updated_at").cast("timestamp"))).alias("m")).first()["m"] or 0)
        age = (newest - F.unix_micros(F.col("updated_at").cast("timestamp"))) / F.lit(86_400_000_000.0 * half_life_days)
        weight = F.when(F.col("rank").isNull(), F.lit(1.0 / (1 << 16))).otherwise(F.lit(1.0) / F.greatest(F.col("rank"), F.lit(1)))
        flat = F.coalesce(weight * F.pow(F.lit(2.0), -age), F.lit(0.0))
    else:
        flat = F.lit(None).cast("double")
    # the field is its place in the rules; -1 counts the record itself
    entry = [F.struct(F.lit(i).alias("field"), F.when(r.usable(F.col(f)), r.normalise(F.col(f))).alias("value")) for i, (f, r) in enumerate(rules.items())]
    entry.append(F.struct(F.lit(-1).alias("field"), F.lit(None).cast("long").alias("value")))
    votes = named.select("id", digit.alias("steep"), flat.alias("flat"), F.explode(F.array(*entry)).alias("e"))
    votes = votes.select("id", "e.field", "e.value", "steep", "flat").filter("field = -1 or value is not null")
    add = lambda n: [F.sum(n).alias("n"), F.max("steep").alias("steep"), F.sum("flat").alias("flat")]
    per_object = votes.groupBy("id", "field", "value").agg(*add(F.lit(1)))
    known = members.filter("id is not null and `group` is not null").select("id", "group").distinct()
    summed = per_object.join(known, "id").groupBy("group", "field", "value").agg(*add(F.col("n")))
    score = F.col("steep") if rule == "order" else F.struct(F.round(F.log2(F.col("flat") + F.lit(1e-300)), 9).alias("flat"), F.col("steep").alias("steep"))
    out = [F.max(F.when(F.col("field") == -1, F.col("n"))).alias("n_records")]
    for i, f in enumerate(rules):
        won = F.max_by(F.struct("value", "steep", "flat"), F.when(F.col("field") == i, score)).alias(f"_{f}")
        out.append(won)
    won = summed.groupBy("group").agg(*out)
    cols = []
    for f in rules:
        cols += [F.coalesce(-F.col(f"_{f}.steep.neg_id"), F.lit(0).cast("long")).alias(f"{f}_rec"), F.col(f"_{f}.value").alias(f"{f}_value"), F.col(f"_{f}.flat").alias(f"{f}_votes")]
    return won.select("group", "n_records", *cols)


RULES = {"seq_len": FieldRule(1_000, 3_000_000), "no_parts": FieldRule(1, 500)}


def _winners(spark: SparkSession, folder: str, rule: str) -> DataFrame:
    records = table(spark, folder, "toy_ids", "rec_id", "id", "seq_len", "no_parts", "provider", "updated_at")
    members = table(spark, folder, "toy_clusters").select(F.col("object").alias("id"), F.col("cluster").alias("group"))
    return field_winners(records, members, table(spark, folder, "providers", "provider", "trust_rank"), RULES, rule=rule).filter("n_records >= 2")


def p1_found(spark: SparkSession, folder: str) -> DataFrame:
    """Per cluster with several records, the record that each field is taken from."""
    return _winners(spark, folder, "order").select(F.col("group").alias("cluster"), F.col("seq_len_rec").alias("seq_len_rec"), F.col("no_parts_rec").alias("no_parts_rec"))


def p1_votes(spark: SparkSession, folder: str) -> DataFrame:
    """The surviving values by summed votes of trust times recency."""
    won = _winners(spark, folder, "votes")
    return won.select(F.col("group").alias("cluster"), "n_records", F.col("seq_len_value").alias("seq_len"), F.col("no_parts_value").alias("no_parts"))


QUERIES = {"p1_found": p1_found, "p1_votes": p1_votes}

_SQL = r"""
with trust as (select regexp_replace(lower(provider), '[^\p{L}\p{N}]', '', 'g') as p, min(trust_rank) as rank from providers group by 1),
     c as (select distinct object, cluster from toy_clusters where object is not null and cluster is not null),
     r as (select c.cluster, i.*, coalesce(trust.rank, 1000000) as rank from toy_ids i join c on c.object = i.id
           left join trust on trust.p = regexp_replace(lower(i.provider), '[^\p{L}\p{N}]', '', 'g') and trust.p <> ''),
     big as (select cluster from r group by 1 having count(*) >= 2),
     s as (select cluster, rec_id, row_number() over (partition by cluster order by rank, updated_at desc nulls last, rec_id) as k from r where seq_len between 1000 and 3000000),
     n as (select cluster, rec_id, row_number() over (partition by cluster order by rank, updated_at desc nulls last, rec_id) as k from r where no_parts between 1 and 500)
select big.cluster, coalesce(s.rec_id, 0) as seq_len_rec, coalesce(n.rec_id, 0) as no_parts_rec
from big left join s on s.cluster = big.cluster and s.k = 1 left join n on n.cluster = big.cluster and n.k = 1
"""
_VOTES = r"""
with trust as (select regexp_replace(lower(provider), '[^\p{L}\p{N}]', '', 'g') as p, min(trust_rank) as rank from providers group by 1),
     c as (select distinct object, cluster from toy_clusters where object is not null and cluster is not null),
     r as (select c.cluster, i.rec_id, i.seq_len, i.no_parts, i.updated_at, trust.rank,
             coalesce(case when trust.rank is null then 1.0 / 65536 else 1.0 / greatest(trust.rank, 1) end * pow(2, epoch_us(i.updated_at) / (86400000000.0 * 30) - 640), 0) as vote
           from toy_ids i join c on c.object = i.id left join trust on trust.p = regexp_replace(lower(i.provider), '[^\p{L}\p{N}]', '', 'g') and trust.p <> ''),
     big as (select cluster, count(*) as n_records from r group by 1 having count(*) >= 2),
     s as (select *, sum(vote) over (partition by cluster, seq_len) as votes from r where seq_len between 1000 and 3000000),
     n as (select *, sum(vote) over (partition by cluster, no_parts) as votes from r where no_parts between 1 and 500),
     s1 as (select cluster, seq_len, row_number() over (partition by cluster order by round(log2(votes + 1e-300), 9) desc, coalesce(rank, 1000000), updated_at desc nulls last, rec_id) as k from s),
     n1 as (select cluster, no_parts, row_number() over (partition by cluster order by round(log2(votes + 1e-300), 9) desc, coalesce(rank, 1000000), updated_at desc nulls last, rec_id) as k from n)
select big.cluster, n_records, s1.seq_len, n1.no_parts::bigint as no_parts
from big left join s1 on s1.cluster = big.cluster and s1.k = 1 left join n1 on n1.cluster = big.cluster and n1.k = 1
"""
ORACLE = {"p1_found": _SQL, "p1_votes": _VOTES}
