"""A1-A10: landing raw records, flattening paged documents, envelopes and
idempotent datapoint upserts.

Records arrive as (tenant_id, stream, payload JSON, fetched_at[, id, run_id]).
``land`` returns the append-only raw rows and the datapoints mapped from
them; both are plain DataFrames, written partitioned by (source,
resource_type) so a resource scan prunes files.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyspark.functions.jsonx import jstr, with_json
from tallyspark.operators.snapshot import order_number, packable

P = "payload"

RAW_COLS = ["id", "tenant_id", "source", "resource_type", "source_id", "payload", "fetched_at", "run_id"]
DP_COLS = ["id", "tenant_id", "source", "tool", "kind", "name", "subject_type", "subject_id", "occurred_at",
           "period_start", "period_end", "observed_at", "source_key", "metadata", "raw_record_id"]


def _nz(c: Column) -> Column:
    """Truthy string: '' counts as missing (Python ``or``)."""
    return F.nullif(c, F.lit(""))


def _s(path: str) -> Column:
    return _nz(jstr(P, path))


def _ts(c: Column) -> Column:
    return c.try_cast("timestamp")


# --- A1, A2, A5 ----------------------------------------------------------------------
def land_raw_append(records: DataFrame, source: str, run_id=None) -> DataFrame:
    """A1: raw rows with natural id ``node_id`` -> ``id`` -> ``sha``.

    Records without an id get one by hash, so a replayed batch gets the same;
    exact repeats of a record in a run share it."""
    rid = F.col("run_id") if "run_id" in records.columns else F.lit(run_id)
    rec_id = F.col("id") if "id" in records.columns else F.sha1(F.to_json(F.struct(
        "tenant_id", F.lit(source).alias("source"), "stream", "payload", F.col("fetched_at").cast("string").alias("at"), rid.cast("string").alias("run"))))
    return records.select(
        rec_id.alias("id"), "tenant_id", F.lit(source).alias("source"), F.col("stream").alias("resource_type"),
        F.coalesce(_s("node_id"), _s("id"), _s("sha")).alias("source_id"),
        "payload", F.col("fetched_at").cast("timestamp").alias("fetched_at"), rid.alias("run_id"))


def write_raw(raw: DataFrame, path: str) -> None:
    """Append-only landing, partitioned so resource scans prune."""
    raw.write.mode("append").partitionBy("source", "resource_type").parquet(path)


def scan_resource(raw: DataFrame, source: str, resource_type: str) -> DataFrame:
    """A2: a source alias is a filter on the partition columns."""
    return raw.where((F.col("source") == source) & (F.col("resource_type") == resource_type))


def updated_since(df: DataFrame, start_date, field: str = "updatedAt") -> DataFrame:
    """A5: keep records updated on/after ``start_date`` (UTC midnight)."""
    if isinstance(start_date, str):
        start_date = dt.date.fromisoformat(start_date[:10])
    start = dt.datetime(start_date.year, start_date.month, start_date.day)
    return df.where(_ts(jstr(P, field)) >= F.lit(start))


# --- A3, A4: paged documents ------------------------------------------------------------
def flatten_pages(pages: DataFrame, connection: str | None = None, doc_col: str = "doc") -> DataFrame:
    """A3: one row per node of ``$.data.<connection>.nodes[*]`` (or ``$[*]``)."""
    path = f"$.data.{connection}.nodes" if connection else "$"
    nodes = F.from_json(F.get_json_object(F.col(doc_col), path), "array<string>")
    keep = [c for c in pages.columns if c != doc_col]
    return pages.select(*keep, F.posexplode(nodes).alias("node_pos", "payload"))


def flatten_history(issues: DataFrame) -> DataFrame:
    """A4: issue nodes -> one row per description edit in ``history.nodes[*]``
    with ``updatedDescription`` true and an id; the parent issue is attached."""
    hist = F.from_json(F.get_json_object(P, "$.history.nodes"), "array<string>")
    issue = F.struct(jstr(P, "id").alias("id"), jstr(P, "identifier").alias("identifier"),
                     jstr(P, "url").alias("url"))
    keep = [c for c in issues.columns if c != "payload"]
    x = issues.select(*keep, issue.alias("_issue"), F.explode(hist).alias("_h"))
    h = F.col("_h")
    ok = (F.get_json_object(h, "$.updatedDescription") == "true") & F.get_json_object(h, "$.id").isNotNull()
    # the edit JSON with the parent issue reference added
    merged = F.concat(F.expr("substring(_h, 1, length(_h) - 1)"), F.lit(',"issue":'), F.to_json("_issue"), F.lit("}"))
    return x.where(ok).select(*keep, merged.alias("payload"))


# --- A6-A8: envelopes ------------------------------------------------------------------------
# Stream -> datapoint name (unlisted streams get no datapoint).
GITHUB_STREAMS = {
    "pull_requests": "pull_request", "commits": "commit", "issues": "issue", "issue_comments": "comment",
    "pull_request_review_comments": "review_comment", "reviews": "review", "releases": "release",
    "workflow_runs": "workflow_run",
}
LINEAR_STREAMS = {"issues": "issue", "comments": "comment", "projects": "project",
                  "issue_description_edits": "description_edit"}
COPILOT_STREAM = "copilot_usage"
COPILOT_IDENTITY_FIELDS = ["day", "date", "user_login", "user", "org", "team"]
GITHUB_META_COMMON = ["number", "state", "html_url", "updated_at", "merged_at", "sha"]
GITHUB_META_EXTRA = {
    "reviews": ["pull_request_number"],
    "releases": ["tag_name", "name", "draft", "prerelease", "published_at"],
    "workflow_runs": ["name", "status", "conclusion", "event", "run_number", "head_branch", "head_sha", "workflow_id"],
    "pull_request_review_comments": ["pull_request_review_id", "pull_request_url", "path", "commit_id",
                                     "pull_request_number"],
}


def _meta(pairs: list[tuple[str, Column]]) -> Column:
    """JSON object of the non-null pairs (``to_json`` omits null struct fields;
    no lambda, so it stays inside whole-stage codegen)."""
    return F.to_json(F.struct(*[v.alias(k) for k, v in pairs]))


#: The payload as a variant, parsed once per row.
STORED = "_stored"


def _as_stored(path: str) -> Column:
    """The payload's value as a variant, so numbers and booleans stay what they are; JSON null is NULL."""
    v = F.try_variant_get(F.col(STORED), f"$.{path}", "variant")
    return F.when(~F.is_variant_null(v), v)


def _case(stream: Column, table: dict[str, Column], default: Column) -> Column:
    out = None
    for s, v in table.items():
        out = F.when(stream == s, v) if out is None else out.when(stream == s, v)
    return out.otherwise(default) if out is not None else default


def _dp_cols(tool: Column, kind: str, name: Column, subject_type: Column, subject_id: Column,
             occurred: Column, source_key: Column, metadata: Column, observed: Column,
             period_start=None, period_end=None) -> list[Column]:
    return [
        F.md5(F.concat_ws("|", F.col("tenant_id"), F.col("source"), source_key, F.col("id").cast("string")))
        .alias("id"),
        F.col("tenant_id"), F.col("source"), tool.alias("tool"), F.lit(kind).alias("kind"), name.alias("name"),
        subject_type.alias("subject_type"), subject_id.alias("subject_id"),
        F.coalesce(occurred, observed).alias("occurred_at"),
        (period_start if period_start is not None else F.lit(None).cast("timestamp")).alias("period_start"),
        (period_end if period_end is not None else F.lit(None).cast("timestamp")).alias("period_end"),
        observed.alias("observed_at"), source_key.alias("source_key"), metadata.alias("metadata"),
        F.col("id").alias("raw_record_id")]


def env_github(raw: DataFrame, observed_at: Column | None = None) -> DataFrame:
    """GitHub streams -> event envelopes (one per raw row of a mapped stream)."""
    rs = F.col("resource_type")
    r = raw.where((F.col("source") == "github") & rs.isin(list(GITHUB_STREAMS)))
    obs = observed_at if observed_at is not None else F.col("fetched_at")
    name = _case(rs, {k: F.lit(v) for k, v in GITHUB_STREAMS.items()}, F.lit(None))
    extra_keys = sorted({k for ks in GITHUB_META_EXTRA.values() for k in ks} - set(GITHUB_META_COMMON))

    def build(g):
        s = lambda p: _nz(g(p))
        login = F.coalesce(s("user.login"), s("author.login"), s("actor.login"), s("triggering_actor.login"),
                           F.lit("unknown"))
        created = _ts(g("created_at"))
        commit_dt = F.coalesce(_ts(g("commit.author.date")), _ts(g("commit.committer.date")))
        occurred = _case(rs, {
            "commits": F.coalesce(commit_dt, created),
            "reviews": _ts(g("submitted_at")),
            "releases": F.coalesce(_ts(g("published_at")), created),
            "workflow_runs": F.coalesce(_ts(g("updated_at")), created),
        }, created)
        natural = F.coalesce(s("id"), s("sha"))
        source_key = F.coalesce(s("node_id"), F.concat(name, F.lit(":"), F.coalesce(natural, F.lit("None"))))
        repo = F.coalesce(F.when(s("org").isNotNull() & s("repo").isNotNull(),
                                 F.concat(s("org"), F.lit("/"), s("repo"))),
                          s("base.repo.full_name"), g("repo"))
        pairs = [("stream", rs), ("repo", repo)] + [(k, _as_stored(k)) for k in GITHUB_META_COMMON]
        pairs += [(k, F.when(rs.isin([st for st, ks in GITHUB_META_EXTRA.items() if k in ks]), _as_stored(k)))
                  for k in extra_keys]
        return _dp_cols(F.lit("github"), "event", name, F.lit("user"), login, occurred, source_key,
                        _meta(pairs), obs)
    return with_json(r, P, build, variant=STORED)


_PERSON = "array<struct<id:string,email:string,displayName:string,name:string>>"


def _first_in_array(path: str) -> Column:
    arr = F.from_json(F.get_json_object(F.col(P), f"$.{path}"), _PERSON)
    ids = F.transform(arr, lambda p: F.coalesce(_nz(p["id"]), _nz(p["email"]), _nz(p["displayName"]),
                                                _nz(p["name"])))
    return F.get(F.filter(ids, lambda x: x.isNotNull()), 0)


def env_linear(raw: DataFrame, observed_at: Column | None = None) -> DataFrame:
    """Linear streams -> event envelopes; no id => no row; ``source_key = name:id``."""
    rs = F.col("resource_type")
    r = raw.where((F.col("source") == "linear") & rs.isin(list(LINEAR_STREAMS)))
    obs = observed_at if observed_at is not None else F.col("fetched_at")
    name = _case(rs, {k: F.lit(v) for k, v in LINEAR_STREAMS.items()}, F.lit(None))

    def build(g):
        s = lambda p: _nz(g(p))

        def person(path):
            return F.coalesce(s(f"{path}.id"), s(f"{path}.email"), s(f"{path}.displayName"), s(f"{path}.name"))
        subject = F.coalesce(_case(rs, {
            "issues": F.coalesce(person("assignee"), person("creator")),
            "comments": F.coalesce(person("user"), person("externalUser")),
            "projects": F.coalesce(person("lead"), person("creator")),
            "issue_description_edits": F.coalesce(
                F.when(rs == "issue_description_edits", _first_in_array("descriptionUpdatedBy")), person("actor")),
        }, F.lit(None)), F.lit("unknown"))
        meta = _case(rs, {
            "issues": _meta([("stream", rs)] + [(k, _as_stored(k)) for k in
                             ["identifier", "title", "url", "priority", "estimate", "updatedAt"]]
                            + [("state", s("state.name")), ("state_type", s("state.type")), ("team", s("team.key")),
                               ("project_id", s("project.id")),
                               ("project_name", F.when(s("project.id").isNotNull(), s("project.name"))),
                               ("assignee_email", s("assignee.email"))]),
            "comments": _meta([("stream", rs)] + [(k, _as_stored(k)) for k in
                               ["url", "issueId", "projectId", "parentId", "updatedAt", "editedAt"]]
                              + [("issue_id", s("issue.id")), ("issue_identifier", s("issue.identifier")),
                                 ("project_id", s("project.id")),
                                 ("project_name", F.when(s("project.id").isNotNull(), s("project.name")))]),
            "projects": _meta([("stream", rs)] + [(k, _as_stored(k)) for k in
                               ["name", "url", "slugId", "priority", "progress", "health", "updatedAt",
                                "targetDate", "startDate"]]
                              + [("status", s("status.name")), ("status_type", s("status.type"))]),
            "issue_description_edits": _meta([("stream", rs), ("issue_id", s("issue.id")),
                                              ("issue_identifier", s("issue.identifier")),
                                              ("issue_url", s("issue.url"))]),
        }, F.lit(None))
        source_key = F.concat(name, F.lit(":"), s("id"))
        cols = _dp_cols(F.lit("linear"), "event", name, F.lit("user"), subject, _ts(g("createdAt")),
                        source_key, meta, obs)
        return [*cols, F.when(s("id").isNotNull(), F.array(F.lit(True))).alias("_ids")]
    # rows without an id yield no datapoint: a generated flag tells them apart (a Filter on the id would be pushed
    # below the parse and parse twice), and columns beside it that nobody reads are not computed
    x = with_json(r, P, build, variant=STORED)
    return x.select(*[c for c in x.columns if c != "_ids"], F.explode_outer("_ids").alias("_has")).where("_has IS NOT NULL").drop("_has")


def env_copilot(raw: DataFrame, observed_at: Column | None = None) -> DataFrame:
    """Daily usage -> measurement over [day, day + 1); subject user, else org, else 'unknown'."""
    r = raw.where(F.col("resource_type") == COPILOT_STREAM)
    obs = observed_at if observed_at is not None else F.col("fetched_at")

    def build(g):
        s = lambda p: _nz(g(p))
        day = _ts(F.coalesce(s("day"), s("date")))
        start = F.date_trunc("day", F.coalesce(day, obs))
        user = F.coalesce(s("user_login"), s("user"))
        subject_type = F.when(user.isNotNull(), "user").otherwise("org")
        subject = F.coalesce(user, s("org"), F.lit("unknown"))
        key = F.concat(subject, F.lit(":"), F.date_format(start, "yyyy-MM-dd"))
        rec = F.from_json(F.col(P), "map<string,variant>")
        rest = F.map_filter(rec, lambda k, v: ~k.isin(COPILOT_IDENTITY_FIELDS))
        meta = F.to_json(F.when(s("org").isNotNull(), F.map_concat(rest, F.create_map(F.lit("org"), s("org").cast("variant"))))
                         .otherwise(rest))
        return _dp_cols(F.lit("github_copilot"), "measurement", F.lit("copilot.usage"), subject_type, subject,
                        start, key, meta, obs, period_start=start, period_end=start + F.expr("INTERVAL 1 DAY"))
    return with_json(r, P, build)


def land(records: DataFrame, source: str, run_id=None) -> tuple[DataFrame, DataFrame]:
    """A1 + A6-A8: (raw rows, datapoints) for one landing batch."""
    raw = land_raw_append(records, source, run_id)
    if source == "linear":
        dps = env_linear(raw)
    else:
        dps = env_github(raw).unionByName(env_copilot(raw))
    return raw, dps


# --- A9, A10: idempotent upserts ---------------------------------------------------------------
EVENT_KEY = ["tenant_id", "source", "source_key"]
MEASURE_KEY = ["tenant_id", "tool", "name", "subject_id", "period_start"]


def dp_event_first_wins(existing: DataFrame, incoming: DataFrame) -> DataFrame:
    """Insert events whose key is new; on conflict do nothing.

    Within the batch the earliest (observed_at, raw_record_id) wins — a
    partial aggregate, so a hot key never gathers its rows in one task. The
    winner's time and landing id are aggregates of their own: a reader of these
    alone has no other column computed, and their fixed-width buffers hash."""
    inc = incoming.where(F.col("kind") == "event")
    own = ["observed_at", "raw_record_id"]
    rest = [c for c in inc.columns if c not in [*EVENT_KEY, *own, "kind"]]
    order = order_number(*own) if packable(inc, *own) else F.struct(*own)
    first = (inc.groupBy(*EVENT_KEY)
             .agg(F.min_by(F.struct(*rest), order).alias("_r"), *[F.min_by(c, order).alias(c) for c in own])
             .select(*EVENT_KEY, F.lit("event").alias("kind"), *own, *[F.col("_r." + c).alias(c) for c in rest]))
    new = first.join(existing.select(*EVENT_KEY), EVENT_KEY, "left_anti")
    return existing.unionByName(new.select(*existing.columns))


def dp_measure_newest_wins(existing: DataFrame, incoming: DataFrame) -> DataFrame:
    """A10: replace a measurement only when the incoming observed_at is strictly
    newer; key columns and ``source_key`` keep their first values."""
    sticky = ["id", "source", "subject_type", "source_key"]
    moving = ["occurred_at", "period_end", "observed_at", "metadata"]
    ex = existing.select("*", F.lit(0).alias("_side"))
    inc = incoming.where(F.col("kind") == "measurement").select("*", F.lit(1).alias("_side"))
    u = ex.unionByName(inc)
    # newest observed_at wins; on a tie the existing row (side 0) stays, then the
    # earliest-landed incoming row (strict "<": a later equal row never replaces)
    order = F.struct(-F.unix_micros("observed_at"), F.col("_side"), F.col("raw_record_id"))
    newest = F.min_by(F.struct(*moving), order)
    first = F.min_by(F.struct(*sticky), F.struct("_side", "raw_record_id"))
    # the landing id is an aggregate of its own: a reader of it alone needs no metadata
    out = (u.groupBy(*MEASURE_KEY)
           .agg(newest.alias("_n"), first.alias("_f"), F.min_by("raw_record_id", order).alias("raw_record_id"))
           .select(*MEASURE_KEY, F.lit("measurement").alias("kind"), *[F.col("_f." + c).alias(c) for c in sticky],
                   *[F.col("_n." + c).alias(c) for c in moving], "raw_record_id"))
    return out.select(*existing.columns)
