"""N-gram Jaccard join with a token-group matrix.

Documents are sets of distinct 5-word shingles (64-bit hashes); two link when
``100 * |A & B| >= percent * |A | B|``. The join runs in four steps:

1. Equal sets collapse to one representative, and only representatives that
   share enough prefix tokens with others go on: in any order of tokens, the first
   ``n - ceil(percent * n / 100) + l`` tokens of two sets that link have ``l`` in
   common, where ``l`` grows with the smaller set (``shared_tokens``). The first
   order is that of the hashes, under which a prefix says the same about its set
   at any size of the input. Of the sets left every token is counted exactly:
   those that hold ``percent`` of their tokens with others stay, and from here on
   a prefix holds the rarest tokens.
2. Similar sets are partitioned into groups: sets with a common minimum hash are
   compared with the one among them that shares the largest part of its prefix
   (an original shares more than its edited copies), then each set with the one
   that holds its rarest shared tokens, and the links make groups.
3. The token-group matrix holds each group's token union. A set of the smaller
   group queries a larger group it shares enough prefix tokens with, by the sizes
   of both (``_pair_needed``); the overlap with
   the union bounds the overlap with every member, and only groups that can
   still reach the threshold are opened.
4. A query of an opened group is compared exactly with the member that shares most
   prefix tokens with it, and, if they do not link, with the members that their
   overlaps with one pivot of the group do not rule out.

Components over all verified links are exact: a pair left out lies in one group
already or is excluded by a bound. No step emits the pairs of a group: copies
and near copies cost one comparison with their leader each.
"""
from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortlens.llm.common import Scratch, list_column, row_chunks, row_key, text_bytes
from cohortlens.llm.components import connected_components
from cohortlens.llm.kernels import shingle_sets

HASH_SHARE = 10           # of a set: tokens that prefixes by hash share, in hundredths
RARE_SHARE = 4            # and those that prefixes by rarity share
MIN_HASHES = 4
SIZE_BAND = 1.05          # sets of a group differ in size by less than this factor
_SEEDS = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93], np.uint64)


def _sets(batch: pa.RecordBatch, k: int):
    """(first row, last row, tokens, offsets) of bounded runs of rows of a batch."""
    data, offsets = text_bytes(batch.column("text"))
    for lo, hi in row_chunks(offsets):
        yield (lo, hi, *shingle_sets(data[offsets[lo]:offsets[hi]], offsets[lo:hi + 1] - offsets[lo], k))


def _signatures(docs: DataFrame, k: int, percent: int) -> DataFrame:
    """Per row: node, doc_id, set size, set identity, minimum hashes and the first tokens by hash."""

    def run(batches):
        for batch in batches:
            for lo, hi, tokens, offsets in _sets(batch, k):
                n = np.diff(offsets)
                signed = tokens.view(np.int64)
                keep, sizes, mins, keys = [], np.zeros(len(n) + 1, np.int64), np.zeros((len(n), MIN_HASHES), np.uint64), []
                if len(tokens):
                    some = np.flatnonzero(n)
                    for j, seed in enumerate(_SEEDS):
                        mins[some, j] = np.minimum.reduceat(tokens * seed, offsets[:-1][some])
                for i in range(len(n)):
                    a, b = offsets[i], offsets[i + 1]
                    keys.append(xxhash.xxh3_128_digest(tokens[a:b].tobytes()) if b > a else None)
                    p = prefix_length(int(b - a), percent, HASH_SHARE)
                    if p:
                        keep.append(signed[a:a + p])
                    sizes[i + 1] = p
                yield pa.RecordBatch.from_arrays([
                    batch.column("node").slice(lo, hi - lo), batch.column("doc_id").slice(lo, hi - lo),
                    pa.array(n, pa.int64()), pa.array(keys, pa.binary()),
                    list_column(mins.view(np.int64).ravel(), np.arange(len(n) + 1) * MIN_HASHES, pa.int64()),
                    list_column(np.concatenate(keep) if keep else np.empty(0, np.int64), np.cumsum(sizes), pa.int64()),
                ], ["node", "doc_id", "n", "set_key", "mins", "prefix"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("node", "doc_id", "text").mapInArrow(
        run, f"node long, doc_id {kind}, n long, set_key binary, mins array<long>, prefix array<long>")


def prefix_length(n: int, percent: int, share: int = RARE_SHARE) -> int:
    """Tokens of an ``n``-set of which a set that links with it holds ``shared_tokens``."""
    return min(n, n - (n * percent + 99) // 100 + shared_tokens(n, share)) if n else 0


def shared_tokens(n, share: int = RARE_SHARE):
    """Prefix tokens that a set of ``n`` must share with a linked set that is no smaller."""
    return n * share // 100 + 1


def _part(n, percent: int):
    """The hundredths ``percent`` of a size column, rounded up."""
    return F.ceil(n * percent / 100)


def _needed(n: str, share: int):
    """Prefix tokens that a set of size column ``n`` shares with any set it links with.

    A smaller partner asks for fewer, but then its prefix ends later among the common tokens; rounding takes one.
    """
    return F.greatest(F.floor(F.col(n) * share / 100), F.lit(1))


def _pair_needed(n: str, lo: str, hi: str, percent: int):
    """Rare prefix tokens that a set of ``n`` shares with a linked set of ``lo`` to ``hi`` tokens.

    Both prefixes hold the first common tokens in the order, each but for as many as its set has
    without the other. That bound is linear in the partner's size but for rounding, which takes two.
    """
    n = F.col(n)
    lo, hi = F.greatest(lo, _part(n, percent)), F.least(hi, F.floor(n * 100 / percent))
    common = lambda m: F.ceil((n + m) * percent / (100 + percent))
    spare = lambda m: F.floor(m * RARE_SHARE / 100) + 1 - _part(m, percent)
    least = F.least(common(lo) + spare(n), common(lo) + spare(lo), common(hi) + spare(hi)) - 2
    return F.greatest(least, F.lit(1))


def _ranked(tokens: DataFrame, percent: int) -> DataFrame:
    """Sets that hold enough tokens with others: (node, n, share, cap, prefix).

    ``share`` is the part of a set's tokens that another set holds, ``cap`` the largest size of a partner
    that this allows. The prefix has the rarest tokens, without those that no other set holds.
    """
    flat = tokens.select("node", "n", F.explode("tokens").alias("token"))
    common = flat.groupBy("token").agg(F.count("*").alias("holders")).where("holders > 1")
    most = F.size("shared")
    length = F.col("n") - _part(F.col("n"), percent) + F.floor(F.col("n") * RARE_SHARE / 100) + 1
    rarest = F.slice("shared", F.lit(1), F.greatest(F.least(length, "n") - (F.col("n") - most), F.lit(0)).cast("int"))
    return (flat.join(common, "token").groupBy("node", "n")
            .agg(F.array_sort(F.collect_list(F.struct("holders", "token"))).alias("shared"))
            .where(most * 100 >= F.col("n") * percent)
            .select("node", "n", (most / F.col("n")).alias("share"),
                    (F.floor(most * (100 + percent) / percent) - F.col("n")).alias("cap"),
                    rarest["token"].alias("prefix")))


def _token_sets(docs: DataFrame, k: int) -> DataFrame:
    """(node, n, tokens) of every distinct row that has words."""
    def run(batches):
        seen: set[int] = set()  # equal rows of one partition give one set
        for batch in batches:
            nodes = batch.column("node").to_numpy(zero_copy_only=False)
            for lo, hi, tokens, offsets in _sets(batch, k):
                n = np.diff(offsets)
                keep = []
                for i in np.flatnonzero(n):
                    if int(nodes[lo + i]) not in seen:
                        seen.add(int(nodes[lo + i]))
                        keep.append(i)
                if keep:
                    parts = [tokens[offsets[i]:offsets[i + 1]] for i in keep]
                    yield pa.RecordBatch.from_arrays([
                        pa.array(nodes[lo:hi][keep], pa.int64()), pa.array(n[keep], pa.int64()),
                        list_column(np.concatenate(parts).view(np.int64),
                                    np.concatenate(([0], np.cumsum(n[keep]))), pa.int64()),
                    ], ["node", "n", "tokens"])

    return docs.select("node", "text").mapInArrow(run, "node long, n long, tokens array<long>")


def _verify(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose sets link, by exact intersection."""
    left = sets.select(F.col("node").alias("a"), F.col("n").alias("na"), F.col("tokens").alias("ta"))
    right = sets.select(F.col("node").alias("b"), F.col("n").alias("nb"), F.col("tokens").alias("tb"))
    return (pairs.join(left, "a").join(right, "b")
            .withColumn("both", F.size(F.array_intersect("ta", "tb")).cast("long"))
            .where(F.col("both") * 100 >= percent * (F.col("na") + F.col("nb") - F.col("both")))
            .select("a", "b"))


def _best_partners(chosen: DataFrame, grouped: DataFrame) -> DataFrame:
    """For each set the set of another component that its prefix says is nearest: (a, b).

    A token offers the holder that shares most; tokens weigh by rarity, so two
    copies that share an edit find each other. One comparison a set, whatever
    the number of holders.
    """
    rows = (chosen.join(grouped, "node", "left")
            .select("node", "share", F.coalesce("center", "node").alias("comp"), F.explode("prefix").alias("token")))
    best = (rows.groupBy("token").agg(F.count("*").alias("holders"), F.min("comp").alias("lo"), F.max("comp").alias("hi"),
                                      F.max_by("node", "share").alias("b"), F.max_by("comp", "share").alias("b_comp"))
            .where("lo < hi").select("token", "holders", "b", "b_comp"))
    near = (rows.join(best, "token").where("comp <> b_comp")
            .groupBy(F.col("node").alias("a"), "b").agg(F.sum(1 / F.col("holders")).alias("weight")))
    return near.groupBy("a").agg(F.max_by("b", "weight").alias("b"))


def _pivot_pairs(left: DataFrame, member: DataFrame, spoken: DataFrame, tokens: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) of queries and members of their opened groups that a pivot does not rule out.

    The pivot is one member a group, against which every query and member is
    measured once. What two sets share lies inside the pivot, where neither has
    more than its overlap with it, or outside, where neither has more than its rest.
    """
    pivots = (spoken.join(left.select("g").distinct(), "g").groupBy("g", "b").count()
              .groupBy("g").agg(F.max_by("b", F.struct("count", "b")).alias("node"))
              .join(tokens.select("node", F.col("tokens").alias("pivot")), "node").select("g", "pivot"))
    inside = F.size(F.array_intersect("tokens", "pivot")).cast("long")
    measured = lambda rows, name, size, both: (
        rows.join(pivots, "g").join(tokens.select("node", "tokens"), "node")
        .select(F.col("node").alias(name), F.col("n").alias(size), "g", inside.alias(both)))
    asking = measured(left, "a", "na", "pa")
    held = measured(member.select("node", "n", F.col("grp").alias("g")), "b", "nb", "pb")
    most = F.least("pa", "pb") + F.least(F.col("na") - F.col("pa"), F.col("nb") - F.col("pb"))
    return (asking.join(held, "g").where(_near_size("na", "nb", percent))
            .where(most * (100 + percent) >= (F.col("na") + F.col("nb")) * percent).select("a", "b").distinct())


def _near_size(a: str, b: str, percent: int):
    """Sizes that allow the threshold."""
    return (F.least(a, b) * 100 >= F.greatest(a, b) * percent)


def jaccard_components(docs: DataFrame, scratch: Scratch, percent: int = 80, k: int = 5,
                       with_row: bool = False) -> DataFrame:
    """One row per row of ``docs(doc_id, text)``: doc_id, n_shingles, component_id.

    ``with_row`` adds ``node``, the row's ``row_key``, and ``center``, the key
    that stands for its component.

    ``component_id`` is the smallest non-null doc_id of the rows reachable by
    links, the row itself included. NULL and word-less texts have size 0 and
    stand alone; NULL doc_ids are linked like any row and are never a component's
    id unless it has no other; repeated rows fall together; other columns of
    ``docs`` are ignored.
    """
    docs = docs.select("doc_id", "text").withColumn("node", row_key("doc_id", "text"))
    sig = scratch.save(_signatures(docs, k, percent), "signatures")
    sets = scratch.save(sig.where("n > 0").groupBy("set_key").agg(F.min("node").alias("rep")), "sets")
    spread = sig.select("node", F.explode("prefix").alias("token"))
    shared = spread.groupBy("token").count().where("count > 1").select("token")
    hits = spread.join(shared, "token", "left_semi").groupBy("node").agg(F.count("*").alias("hits"))
    reps = sig.join(sets.select(F.col("rep").alias("node")), "node", "left_semi").select("node", "n")
    busy = scratch.save(hits.join(reps, "node").where(F.col("hits") >= _needed("n", HASH_SHARE))
                        .select("node").distinct(), "busy")
    rows = scratch.save(sig.select("node", "doc_id", "n", "set_key"), "rows")
    marks = scratch.save(sig.select("node", "mins").join(busy, "node", "left_semi").dropDuplicates(["node"]), "marks")
    scratch.drop("signatures")

    tokens = scratch.save(_token_sets(docs.join(busy, "node", "left_semi"), k), "tokens")
    chosen = scratch.save(_ranked(tokens, percent).join(marks, "node"), "chosen")
    tokens = scratch.save(tokens.join(chosen.select("node"), "node", "left_semi"), "chosen_tokens")
    scratch.drop("tokens", "busy", "marks")

    # groups of similar sets: the star of each minimum hash, verified
    keys = chosen.select("node", "share", F.posexplode("mins").alias("i", "key"))
    leader = keys.groupBy("i", "key").agg(F.max_by("node", "share").alias("b"))
    stars = (keys.join(leader, ["i", "key"]).where("node <> b").select(F.col("node").alias("a"), "b").distinct())
    links = scratch.save(_verify(stars, tokens, percent), "star_links")
    stars_of = connected_components(links, scratch, "stars")
    links = scratch.save(links.unionByName(_verify(_best_partners(chosen, stars_of), tokens, percent)), "near_links")
    scratch.drop("star_links")
    grouped = connected_components(links, scratch, "groups")

    # a group is one size band of a component: its smallest member then says much about all
    band = F.floor(F.log("n") / np.log(SIZE_BAND))
    member = scratch.save(chosen.join(grouped, "node", "left")
                          .select("node", "n", "cap", F.coalesce("center", "node").alias("comp"), "prefix")
                          .withColumn("grp", F.xxhash64("comp", band)), "member")

    # token-group matrix, restricted to prefix tokens that meet several components
    cells = member.select("node", "n", "cap", "comp", "grp", F.explode("prefix").alias("token"))
    multi = cells.groupBy("token").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo < hi")
    cells = scratch.save(cells.join(multi.select("token"), "token", "left_semi"), "cells")
    # only sets with enough prefix tokens that another component holds can link with one
    able = cells.groupBy("node", "n").count().where(F.col("count") >= _needed("n", RARE_SHARE)).select("node")
    cells = scratch.save(cells.join(able, "node", "left_semi"), "able")
    sizes = member.groupBy("comp").agg(F.count("*").alias("members"))
    ranked = cells.join(sizes, "comp")
    targets = ranked.groupBy("token", "grp").agg(
        F.first("comp").alias("g_comp"), F.first("members").alias("g_members"), F.min("n").alias("g_lo"),
        F.max("n").alias("g_hi"), F.max("cap").alias("g_cap")).withColumnRenamed("grp", "g")
    asks = (ranked.join(targets, "token")
            .where("struct(g_members, g_comp) > struct(members, comp)")
            .where(f"g_hi * 100 >= n * {percent} and n * 100 >= g_lo * {percent} and g_lo <= cap and n <= g_cap")
            .groupBy("node", "n", "g").agg(F.count_distinct("token").alias("hits"),
                                           F.min("g_lo").alias("lo"), F.max("g_hi").alias("hi"))
            .where(F.col("hits") >= _pair_needed("n", "lo", "hi", percent)).select("node", "n", "g"))
    asks = scratch.save(asks, "asks")

    wanted = asks.select(F.col("g").alias("grp")).distinct()
    held = member.join(wanted, "grp", "left_semi").select("node", "n", F.col("grp").alias("g"))
    least = held.groupBy("g").agg(F.min("n").alias("g_lo"))
    union = (tokens.select("node", "tokens").join(held.select("node", "g"), "node")
             .select("g", F.explode("tokens").alias("token")).distinct())
    asked = tokens.select("node", "tokens").join(asks, "node").select("node", "n", "g", F.explode("tokens").alias("token"))
    # J >= p / 100 means 100 + p times the overlap is at least p times both sizes together
    reach = F.greatest("g_lo", F.ceil(F.col("n") * percent / 100))
    opened = scratch.save(asked.join(union, ["g", "token"]).groupBy("node", "n", "g").agg(F.count("*").alias("bound"))
                          .join(least, "g").where(F.col("bound") * (100 + percent) >= (F.col("n") + reach) * percent)
                          .select("node", "n", "g"), "opened")
    # one link with any member puts a query into the group's component, so it first meets the member that
    # answers for most of its tokens; only groups in which that one does not link are searched member by member
    queries = opened.join(cells.select("node", "token"), "node")
    speakers = (cells.select(F.col("node").alias("b"), F.col("n").alias("nb"), F.col("grp").alias("g"), "token")
                .groupBy("g", "token").agg(F.min(F.struct("b", "nb")).alias("s")).select("g", "token", "s.b", "s.nb"))
    spoken = scratch.save(queries.join(speakers, ["g", "token"]).groupBy("node", "g", "b").agg(F.count("*").alias("hits"))
                          .groupBy(F.col("node").alias("a"), "g").agg(F.max_by("b", "hits").alias("b")), "spoken")
    first = scratch.save(_verify(spoken.select("a", "b").distinct(), tokens, percent).join(spoken, ["a", "b"]), "first_links")
    left = opened.join(first.select(F.col("a").alias("node"), "g"), ["node", "g"], "left_anti")
    pairs = _pivot_pairs(left, member, spoken, tokens, percent)
    links = scratch.save(links.unionByName(first.select("a", "b")).unionByName(_verify(pairs, tokens, percent)), "links")

    found = connected_components(links, scratch, "components")
    per_row = (rows.join(sets, "set_key", "left")
               .join(found.withColumnRenamed("node", "rep"), "rep", "left")
               .select("node", "doc_id", "n", F.coalesce("center", "rep", "node").alias("center")))
    lowest = per_row.groupBy("center").agg(F.min("doc_id").alias("component_id"))
    out = per_row.join(lowest, "center").withColumnRenamed("n", "n_shingles").select(
        "doc_id", "n_shingles", "component_id", *(["node", "center"] if with_row else []))
    out = scratch.save(out, "result")
    scratch.drop(*(scratch.live - {"result"}))
    return out
