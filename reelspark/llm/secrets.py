"""Operator 3 — secret scans with corpus-wide ownership frequency.

Candidates are found by three patterns. The hash of every candidate's value is then counted over
the corpus by distinct repositories and distinct owners: a value that one owner alone holds and
that looks like a credential is *live*; one that several owners hold is a copied *example*. Live
values are reported as spans of their own beside the candidates.

Only DataFrame and SQL functions run here. Positions come from cutting the text at the matches:
the pieces between them and the matches alternate, so their lengths add up to every start.

Null and empty texts have no spans. Rows are numbered once and the numbered table is written, so
repeated rows and null ids stay rows of their own. A null owner or repository counts as one
owner or repository named ''. Ties between spans at one start go by kind. Extra columns are kept by
``redact`` and not read by ``scan``; columns named like the result's are no clash, as only id,
text, owner and repository are read. A hot value is pre-aggregated before it is counted.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import marked, shared_table

# Fixed patterns of the base scan, and the least length of what each has to hold.
ASSIGN = r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]{24,}"
KINDS = ("assign", "access", "hex", "live")

#: A value looks live if it has both letters and digits, and none of the stock words of examples.
_EXAMPLE_WORDS = r"(?i)example|sample|dummy|changeme|placeholder|your|xxxx|1234567|abcdef"
#: Matches of a text whose places are summed up in one array.
FOLD = 256


def matches(text: Column, pattern: str, kind: int, value_group: int, least: int,
            whole: bool) -> Column:
    """Array of (start, kind, end, value) of the leftmost non-overlapping matches whose value
    (``whole``: the match) has ``least`` code points; the value ends where the match ends."""
    pattern_sql = F.lit(pattern)
    found = F.zip_with(F.regexp_extract_all(text, pattern_sql, F.lit(0)),
                       F.regexp_extract_all(text, pattern_sql, F.lit(value_group)),
                       lambda m, v: F.struct(F.length(m).alias("size"), v.alias("value")))
    gaps = F.transform(F.split(text, pattern, -1), F.length)
    steps = F.zip_with(found, F.slice(gaps, F.lit(1), F.size(found)),
                       lambda f, g: F.struct(g.alias("gap"), f["size"].alias("size"), f["value"].alias("value")))
    spans = "array<struct<start:int,kind:int,end:int,value:string>>"
    empty = F.expr(f"cast(array() as {spans})")
    # Running sums in blocks: adding to an array copies it, so no array that is added to grows with the matches.
    # (an array around ``steps`` names it, so that the blocks do not search the text again)
    blocks = F.flatten(F.transform(F.array(steps), lambda all_: F.transform(
        F.sequence(F.lit(0), F.greatest(F.ceil(F.size(all_) / FOLD).cast("int") - 1, F.lit(0))),
        lambda b: F.slice(all_, b * FOLD + 1, F.lit(FOLD)))))
    each = F.transform(blocks, lambda block: F.aggregate(
        block, F.struct(F.lit(0).alias("at"), empty.alias("out")),
        lambda acc, s: F.struct(
            (acc["at"] + s["gap"] + s["size"]).alias("at"),
            F.concat(acc["out"], F.array(F.struct(
                (acc["at"] + s["gap"]).alias("start"), F.lit(kind).alias("kind"),
                (acc["at"] + s["gap"] + s["size"]).alias("end"), s["value"].alias("value")))).alias("out"))))
    walked = F.flatten(F.aggregate(
        each, F.struct(F.lit(0).alias("at"), F.expr(f"cast(array() as array<{spans}>)").alias("out")),
        lambda acc, e: F.struct(
            (acc["at"] + e["at"]).alias("at"),
            F.concat(acc["out"], F.array(F.transform(e["out"], lambda x: F.struct(
                (x["start"] + acc["at"]).alias("start"), x["kind"].alias("kind"), (x["end"] + acc["at"]).alias("end"),
                x["value"].alias("value"))))).alias("out")),
        lambda acc: acc["out"]))
    kept = F.filter(walked, lambda x: (x["end"] - x["start"] if whole else F.length(x["value"])) >= least)
    return F.when(text.rlike(pattern), kept).otherwise(empty)


def joined(spans: Column) -> Column:
    """kind:start:end by start, then kind, comma-joined."""
    name = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(F.array_sort(spans), lambda x: F.concat_ws(
        ":", F.element_at(name, x["kind"] + 1), x["start"].cast("string"), x["end"].cast("string"))), ",")


def owner_and_repo(owner_col: str | None, repo_cols: tuple[str, ...]) -> tuple[Column, Column]:
    name = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    return name(owner_col) if owner_col else F.lit(""), F.concat_ws("\n", *map(name, repo_cols)) if repo_cols else F.lit("")


def find(docs: DataFrame, text_col: str, owner_col: str | None, repo_cols: tuple[str, ...],
         keep: list[str], with_digest: bool = False) -> DataFrame:
    """The columns ``keep`` of ``docs`` in a struct ``doc``, with ``row``, ``owner``, ``repo``, ``base``
    (the candidates by start and kind) and if asked the text's ``digest``; written once, so that ``row`` is fixed."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    owner, repo = owner_and_repo(owner_col, repo_cols)
    doc = [F.struct(*[F.col(f"`{c}`") for c in keep]).alias("doc")] if keep else []
    digest = [F.md5(text.cast("binary")).alias("digest")] if with_digest else []
    found = docs.select(*doc, *digest, text.alias("text"), owner.alias("owner"), repo.alias("repo"))
    base = F.array_sort(F.concat(matches(F.col("text"), ASSIGN, 0, 2, 6, False),
                                 matches(F.col("text"), ACCESS, 1, 0, 20, True),
                                 matches(F.col("text"), HEX, 2, 0, 24, True)))
    return shared_table(found.withColumns({"base": base, "row": F.monotonically_increasing_id()})
                        .drop("text"), "secret-candidates")


def ownership(found: DataFrame, max_owners: int = 1, max_repos: int = 2) -> DataFrame:
    """``hash``, ``n_owners``, ``n_repos``, ``live`` of every candidate value in the corpus."""
    values = (found.where(F.size("base") > 0)
              .select("owner", "repo", F.explode(F.array_distinct(F.transform("base", lambda x: x["value"]))).alias("value")))
    looks = (F.col("value").rlike("[A-Za-z]") & F.col("value").rlike("[0-9]")
             & ~F.col("value").rlike(_EXAMPLE_WORDS))
    return (values.groupBy(F.sha2("value", 256).alias("hash"), "owner", "repo", looks.alias("looks")).agg(F.lit(1))
            .groupBy("hash", "looks").agg(F.count_distinct("owner").alias("n_owners"),
                                          F.count_distinct("owner", "repo").alias("n_repos"))
            .select("hash", "n_owners", "n_repos",
                    (F.col("looks") & (F.col("n_owners") <= max_owners) & (F.col("n_repos") <= max_repos)).alias("live")))


def with_live(found: DataFrame, max_owners: int, max_repos: int) -> DataFrame:
    """``found`` with ``live``: spans of live values, distinct; empty where there are none."""
    owned = shared_table(ownership(found, max_owners, max_repos).where("live").select("hash"), "live-hashes")
    values = (found.where(F.size("base") > 0).select("row", F.explode("base").alias("m"))
              .select("row", F.sha2("m.value", 256).alias("hash"),
                      F.struct((F.col("m.end") - F.length("m.value")).cast("int").alias("start"),
                               F.lit(3).alias("kind"), F.col("m.end").cast("int").alias("end")).alias("span")))
    live = values.join(owned, "hash").groupBy("row").agg(F.collect_set("span").alias("live"))
    none = F.expr("cast(array() as array<struct<start:int,kind:int,end:int>>)")
    return found.join(live, "row", "left").withColumn("live", F.coalesce("live", none))


def plain(spans: str) -> Column:
    return F.transform(spans, lambda x: F.struct(x["start"], x["kind"], x["end"]))


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", owner_col: str | None = "source",
         repo_cols: tuple[str, ...] = ("source", "lang"), max_owners: int = 1, max_repos: int = 2) -> DataFrame:
    """One row per document: ``id_col``, ``n_assign``, ``n_access``, ``n_hex``, ``n_live``,
    ``base_sha256``, ``spans`` (base and live)."""
    found = find(docs, text_col, owner_col, repo_cols, [id_col])
    count = lambda k: F.size(F.filter("base", lambda x: x["kind"] == k)).cast("long")
    found = found.select(F.col(f"doc.`{id_col}`").alias(id_col), "row", "owner", "repo", "base")
    return with_live(found, max_owners, max_repos).select(
        id_col, count(0).alias("n_assign"), count(1).alias("n_access"), count(2).alias("n_hex"),
        F.size("live").cast("long").alias("n_live"),
        F.sha2(joined(plain("base")), 256).alias("base_sha256"),
        joined(F.concat(plain("base"), F.col("live"))).alias("spans"))


def redact(docs: DataFrame, text_col: str = "text", owner_col: str | None = "source",
           repo_cols: tuple[str, ...] = ("source", "lang"), mark: str = "[SECRET]", max_owners: int = 1,
           max_repos: int = 2) -> DataFrame:
    """``docs`` with every live value in the text replaced by ``mark``; same columns and rows."""
    # Live spans depend on the text, its owner and repository; only rows that have some are joined with them.
    found = find(docs, text_col, owner_col, repo_cols, [], with_digest=True).where(F.size("base") > 0)
    live = shared_table(with_live(found, max_owners, max_repos).where(F.size("live") > 0)
                        .select(F.col("digest").alias("_digest"), F.col("owner").alias("_owner"), F.col("repo").alias("_repo"), F.col("live").alias("_live"))
                        .dropDuplicates(["_digest", "_owner", "_repo"]), "live-spans")
    owner, repo = owner_and_repo(owner_col, repo_cols)
    text = F.col(text_col).cast("string")
    rows = docs.withColumns({"_digest": F.md5(F.coalesce(text, F.lit("")).cast("binary")), "_owner": owner, "_repo": repo})
    rows = marked(rows, F.xxhash64("_digest", "_owner", "_repo"), live.select(F.xxhash64("_digest", "_owner", "_repo")))
    # Live spans by start; one that begins inside the span before it is left to that span.
    cleaned = F.aggregate(
        F.array_sort("_live"), F.struct(F.lit(1).alias("at"), F.lit("").alias("out")),
        lambda acc, s: F.when(s["end"] < acc["at"], acc).otherwise(F.struct(
            (s["end"] + 1).alias("at"),
            F.concat(acc["out"], F.when(s["start"] + 1 >= acc["at"], F.concat(
                F.substring(text, acc["at"], s["start"] + 1 - acc["at"]), F.lit(mark))).otherwise(F.lit(""))).alias("out"))),
        lambda acc: F.concat(acc["out"], F.substring(text, acc["at"], F.length(text))))
    changed = rows.where("_may").join(live.hint("merge"), ["_digest", "_owner", "_repo"], "left").withColumn(
        text_col, F.when(F.col("_live").isNotNull(), cleaned).otherwise(text))
    same = [F.col(f"`{c}`") for c in docs.columns]
    return rows.where("not _may").withColumn(text_col, text).select(*same).unionByName(changed.select(*same))
