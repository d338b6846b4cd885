"""Collision-free file names.

``stateless`` numbers equal names in path order (by component) and ignores what is on disk: one
window.  ``allocate`` follows files one after the other, with the names freed and taken
on the way; the state is a folder's names, or those of them that are alike but for numbers.
"""

from __future__ import annotations

import re
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..staging import BROADCAST_ROWS, cut, small, table
from . import scan

#: Sets of alike names above this many are numbered by ranges, folders are dealt to tasks by their names.
LARGE = 100_000
_NUMBERED = re.compile(r"(.*) \((\d{1,9})\)(\.[^.]*)", re.DOTALL)


def wanted_names(tracks: DataFrame) -> DataFrame:
    return tracks.withColumn("wanted", T.track_file_name("track_number", "artist", "title"))


def stateless(named: DataFrame) -> DataFrame:
    """Add ``new_name``: the wanted stem, with ' (2)', ' (3)' ... after the first of equal ones in a folder."""
    w = Window.partitionBy("parent", "wanted", "ext").orderBy(T.path_parts("path"))
    n = F.row_number().over(w)
    return named.withColumn("_n", n).withColumn("new_name", F.concat("wanted", F.when(F.col("_n") > 1, F.format_string(" (%d)", "_n")).otherwise(""), "ext")).drop("_n")


def allocate(named: DataFrame, compat: bool = False) -> DataFrame:
    """(parent, path, new_name) by sequential allocation in path order (by component).

    A file whose wanted name is its own keeps it.  With ``compat`` its present name
    counts as taken while it looks for another, so that twins swap numbers on every
    run; without, a rerun changes nothing.

    What names a file may get depends on names alike but for numbers in brackets, and on when those are left.
    A set of alike names in which one name is wanted and none is left meanwhile needs no run file by file: the position
    among free numbers and claims in one order is the number.  Windows give it, and ranges in sets of more than ``LARGE``
    names, which are looked for among hashes of sets.  All other sets are followed in Python, those of one folder together,
    or dealt by such names to many tasks if they have more than ``LARGE`` rows.  Just a larger set of that kind is one task.
    A null wanted name leaves the file as it is.
    """

    def follow(pdf: pd.DataFrame) -> pd.DataFrame:
        parts = [p.split("/") for p in pdf["path"]]
        pdf = pdf.iloc[sorted(range(len(pdf)), key=parts.__getitem__)]
        taken, out, last = set(pdf["own"][pdf["holds"]]), [], {}

        def free(name: str) -> None:
            taken.discard(name)
            if m := _NUMBERED.fullmatch(name):  # a lower number can be had again
                key = m[1] + m[3]
                last[key] = min(last.get(key, 1), max(int(m[2]) - 1, 1))

        for path, name, want, ext, claims, moves in zip(*(pdf[c] for c in ("path", "own", "wanted", "ext", "claims", "moves")), strict=True):
            if not claims:
                if moves:
                    free(name)
                continue
            key = new = f"{want}{ext}"
            if not compat:
                free(name)
            k = last.get(key, 1)
            while new in taken:
                k += 1
                new = f"{want} ({k}){ext}"
            last[key] = max(k - 1, 1)
            free(name)
            taken.add(new)
            out.append((pdf["parent"].iloc[0], path, new))
        return pd.DataFrame(out, columns=["parent", "path", "new_name"], dtype=object)

    track = F.coalesce("is_track", F.lit(True)) if "is_track" in named.columns else F.lit(True)
    moves = track & (_own() != F.coalesce(F.concat("wanted", "ext"), _own()))
    rows = table(named.select("parent", "path", "wanted", "ext", moves.alias("moves")))
    uses, new = _uses(rows), None
    if 2 * (n := rows.count()) > LARGE:
        bucket = F.pmod("set", F.lit(-(-32 * n // LARGE)))
        full = cut(uses.groupBy(bucket.alias("bucket")).agg(F.count("*").alias("n")).where(F.col("n") > LARGE).select("bucket"))
        if n := full.count():
            full = F.broadcast(full) if n <= BROADCAST_ROWS else full
            dealt = uses.withColumn("bucket", bucket)
            new, rest = _by_ranges(table(dealt.join(full, "bucket", "left_semi").drop("bucket")))
            uses = dealt.join(full, "bucket", "left_anti").drop("bucket").union(rest)
    judged = _judged(uses)
    followed = judged.where("way = 'follow'").withColumn("own", _own())
    folders = cut(followed.groupBy("parent").agg(F.count("*").alias("rows")).where(F.col("rows") > LARGE))
    if n := folders.count():
        followed = followed.join(F.broadcast(folders) if n <= BROADCAST_ROWS else folders, "parent", "left")
        deal = F.when(F.col("rows").isNull(), 0).otherwise(F.pmod(F.xxhash64("root"), F.ceil(F.col("rows") / LARGE)))
    else:
        deal = F.lit(0)
    told = followed.withColumn("deal", deal.cast("long")).groupBy("parent", "deal").applyInPandas(follow, "parent string, path string, new_name string")
    among = judged.where("way = 'among'")
    numbered = lambda df, order: df.withColumn("_n", F.row_number().over(Window.partitionBy("parent", "root").orderBy(*order)))
    asked = among.where("claims").select("parent", "root", "path", "wanted", "ext", "_n")
    held = among.where(~F.col("claims")).select("parent", "root", _number(F.col("wanted"), F.col("ext")).alias("number"))
    kept = rows.where(~F.col("moves")).select("parent", "path", _own().alias("new_name"))
    direct = judged.where("way = 'direct'").select("parent", "path", _named().alias("new_name"))
    given = _lowest_free(held, asked, ["parent", "root"], numbered).select("parent", "path", _named().alias("new_name"))
    all_but = kept.union(direct).union(given).union(told)
    return all_but if new is None else all_but.union(new)


def _own() -> Column:
    return F.substring_index("path", "/", -1)


def _named() -> Column:
    return F.concat("wanted", F.when(F.col("_n") > 1, F.concat(F.lit(" ("), F.col("_n").cast("string"), F.lit(")"))).otherwise(""), "ext")


def _uses(rows: DataFrame) -> DataFrame:
    """A row for each set of alike names that a file has to do with: one it wants a name of (claims), one that its own name is of (holds)."""
    root = lambda c: F.when(c.contains(" ("), F.regexp_replace(c, r" \(\d+\)", "")).otherwise(c)
    asked, of = root(F.concat("wanted", "ext")), root(_own())
    hashed = lambda c: F.xxhash64("parent", c).alias("set")
    none = F.lit(None).cast("string")
    claims = rows.where("moves").select(hashed(asked), "parent", asked.alias("root"), "path", "wanted", "ext", "moves", F.lit(True).alias("claims"), (asked == of).alias("holds"))
    held = rows.where(~F.col("moves") | (asked != of)).select(hashed(of), "parent", of.alias("root"), "path", none.alias("wanted"), none.alias("ext"), "moves", F.lit(False).alias("claims"), F.lit(True).alias("holds"))
    return claims.union(held)


def _judged(uses: DataFrame) -> DataFrame:
    """Uses of sets in which names are wanted, written down with the way to find these.

    way is 'direct' (_n is the number), 'among' (numbers of the set are held; _n counts claims, others have the name that is wanted
    as wanted and ext) or 'follow'.
    """
    sets = ["set", "parent", "root"]  # the hash settles nearly all comparisons of a sort
    of, name = Window.partitionBy(*sets), F.when(F.col("claims"), F.struct("wanted", "ext"))
    counted = uses.withColumn("_n", F.row_number().over(of.orderBy(F.desc("claims"), T.path_parts("path"))))
    about = {"least": F.min(name), "most": F.max(name), "left": F.max(F.col("moves") & F.col("holds")), "held": F.max(~F.col("claims"))}
    known = counted.select("*", *(f.over(of).alias(c) for c, f in about.items())).where("least IS NOT NULL")
    way = F.when(F.col("left") | (F.col("least") != F.col("most")), "follow").when(F.col("held"), "among").otherwise("direct")
    known = known.withColumn("way", way)
    other = lambda c: F.when(F.col("way") != "direct", F.col(c)).alias(c)
    wanted = lambda c: F.when(F.col("way") == "among", F.col(f"least.{c}")).otherwise(F.col(c)).alias(c)
    return table(known.select("way", "parent", other("root"), "path", wanted("wanted"), wanted("ext"), "_n", "claims", other("moves"), other("holds")))


def _number(base: Column, end: Column) -> Column:
    """Which number of the name base + end a file's own name is; null if it is none."""
    own = _own()
    digits = F.regexp_extract(F.substring(own, F.length(base) + 1, F.length(own)), r"^ \(([1-9]\d{0,8})\)", 1)
    return F.when(own == F.concat(base, end), 1).when((digits != "1") & (own == F.concat(base, F.lit(" ("), digits, F.lit(")"), end)), digits.try_cast("long"))


def _lowest_free(held: DataFrame, asked: DataFrame, keys: list[str], numbered: Callable[[DataFrame, list[str]], DataFrame]) -> DataFrame:
    """asked with the lowest number for each _n-th claim that neither an earlier one has nor held (keys, number) as _n; numbered adds positions in an order."""
    taken = numbered(held.where("number IS NOT NULL").distinct(), ["number"])
    gaps = taken.select(*keys, (F.col("number") - F.col("_n")).alias("at"), F.lit(0).alias("claim"))
    claims = asked.withColumns({"at": (F.col("_n") - 1).cast("long"), "claim": F.lit(1)}).drop("_n")
    return numbered(claims.unionByName(gaps, allowMissingColumns=True), ["at", "claim"]).where("claim = 1")


def _by_ranges(uses: DataFrame) -> tuple[DataFrame | None, DataFrame]:
    """Names for large sets of alike names that stay as they are, and the uses of all other sets."""
    name = F.when(F.col("claims"), F.struct("wanted", "ext"))
    sets = uses.groupBy("parent", "root").agg(F.count("*").alias("n"), F.min(name).alias("least"), F.max(name).alias("most"), F.max(F.col("moves") & F.col("holds")).alias("left"))
    still = sets.where((F.col("n") > LARGE) & ~F.col("left") & (F.col("least") == F.col("most")))
    large = cut(still.select(F.monotonically_increasing_id().alias("_set"), F.col("parent").alias("_parent"), F.col("root").alias("_root"), F.col("least.wanted").alias("base"), F.col("least.ext").alias("end")))
    n = large.count()
    if not n:
        return None, uses
    known = F.broadcast(large) if n <= BROADCAST_ROWS else large
    same = F.col("parent").eqNullSafe(F.col("_parent")) & (F.col("root") == F.col("_root"))
    rest, mine = uses.join(known, same, "left_anti"), uses.join(known, same)
    numbered = lambda df, order: scan.ranked(df, ["_set"], order, "_n")
    asked = numbered(mine.where("claims").select("_set", "path", T.path_parts("path").alias("_parts")), ["_parts"]).drop("_parts")
    held = mine.where(~F.col("claims")).select("_set", _number(F.col("base"), F.col("end")).alias("number"))
    placed = _lowest_free(held, asked, ["_set"], numbered).join(known, "_set").select(F.col("_parent").alias("parent"), "path", F.col("base").alias("wanted"), F.col("end").alias("ext"), "_n")
    return placed.select("parent", "path", _named().alias("new_name")), rest


def sidecar_owners(tracks: DataFrame) -> DataFrame:
    """Tracks (path, ...) of which each is the first, in order of path components, that shares its sidecar; with lrc, the sidecar's path."""
    named = tracks.withColumn("lrc", T.with_suffix("path", ".lrc"))
    w = Window.partitionBy("lrc").orderBy(T.path_parts("path"))
    return named.withColumn("_rank", F.row_number().over(w)).where("_rank = 1").drop("_rank")


def sidecar_moves(moves: DataFrame, files: DataFrame, tracks: DataFrame) -> DataFrame:
    """(src, dst, kind, status) of the .lrc files beside moved tracks (src, dst): a sidecar goes with the first of the tracks that share it.

    One whose place is taken, by a file that is there or by a sidecar of an earlier source, is a conflict.
    """
    owned = sidecar_owners(tracks.select("path")).withColumnRenamed("path", "_owner")
    lrc = moves.select(F.col("src").alias("_owner"), T.with_suffix("dst", ".lrc").alias("dst")).join(owned, "_owner").select(F.col("lrc").alias("src"), "dst")
    lrc = cut(lrc.where("src <> dst"))
    asked = cut(lrc.select(F.explode(F.array("src", "dst")).alias("path")).distinct())
    there = small(cut(files.select("path").join(small(asked), "path", "left_semi").distinct()))  # one pass over all files
    lrc = lrc.join(there.withColumnRenamed("path", "src"), "src", "left_semi").join(there.select(F.col("path").alias("dst"), F.lit(True).alias("_there")), "dst", "left")
    first = F.row_number().over(Window.partitionBy("dst").orderBy(T.path_parts("src"))) == 1
    return lrc.select("src", "dst", F.lit("sidecar").alias("kind"), F.when(F.col("_there").isNull() & first, "planned").otherwise("conflict").alias("status"))


def rename_actions(allocated: DataFrame, files: DataFrame, tracks: DataFrame | None = None) -> DataFrame:
    """(src, dst, kind, status) for tracks and their sidecars; a sidecar whose place is taken is a conflict, never overwritten.

    tracks (path) are all that may own a sidecar, those that keep their names included; without them, the renamed ones.
    """
    dst = F.concat("parent", F.lit("/"), "new_name")
    moves = allocated.select(F.col("path").alias("src"), dst.alias("dst"), F.lit("rename").alias("kind")).where("src <> dst")
    lrc = sidecar_moves(moves, files, moves.select(F.col("src").alias("path")) if tracks is None else tracks)
    return moves.withColumn("status", F.lit("planned")).unionByName(lrc)


def header_writes(tracks: DataFrame, plan: DataFrame, lyrics: DataFrame) -> DataFrame:
    """(path, text) of sidecars whose [ar:] and [ti:] lines must change, at their place after the plan; lyrics are (parent, stem, text).

    A sidecar names the first of the tracks that share it; one in conflict stays as it is.
    """
    moved = plan.where("kind = 'sidecar'").select(F.col("src").alias("lrc"), F.when(F.col("status") == "planned", F.col("dst")).alias("to"), F.col("status").alias("_status"))
    named = sidecar_owners(tracks).select("lrc", "artist", "title")
    texts = lyrics.select(F.concat("parent", F.lit("/"), "stem", F.lit(".lrc")).alias("lrc"), "text")
    new = T.sync_headers("text", "artist", "title")
    rows = texts.join(named, "lrc").join(moved, "lrc", "left").where("coalesce(_status, 'planned') = 'planned'").select(F.coalesce("to", "lrc").alias("path"), "text", new.alias("new"))
    return rows.where("text <> new").select("path", F.col("new").alias("text"))


def slots(requests: DataFrame, interval: float, keys: list[str], at: str, order: list[str], blocks: int | None = None) -> DataFrame:
    """Add ``slot``: when each request may go if requests of a key are at least ``interval`` apart, in arrival order.

    The n-th request goes at n intervals after the latest of (arrival - its number's intervals) up to it: a running
    maximum, taken range by range (see ``scan``), so that one key's requests spread over tasks.
    """
    placed = scan.positions(requests, keys, order, "_n", blocks).withColumn("_n", F.col("_n") - 1).withColumn("_over", F.col(at) - F.col("_n") * interval)
    on = [*keys, "_block"]
    tops = scan.carried(placed.groupBy(*on).agg(F.max("_over").alias("_over")), keys, "_over", F.max, "_top")
    run = Window.partitionBy(*on).orderBy("_n").rowsBetween(Window.unboundedPreceding, 0)
    out = scan.with_carried(placed.withColumn("_run", F.max("_over").over(run)), tops, keys, "_top")
    return out.withColumn("slot", F.col("_n") * interval + F.greatest("_run", "_top")).drop("_n", "_over", "_run", "_top", "_block")
