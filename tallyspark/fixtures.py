"""Adapters from the driver's Parquet tables to the reference's record shapes.

Every adapter reads a whole table and derives rows by column rules, so the
work grows with the input. The raw-record adapters build realistic JSON
payloads per resource from ``events`` columns; the field rules are SQL
expressions that mean the same in Spark SQL and DuckDB, so the oracle can use
them as typed columns while Spark goes through the JSON round trip.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_READS: dict = {}


def _session_key(spark: SparkSession):
    try:
        return spark.sparkContext.applicationId
    except Exception:  # Spark Connect: no SparkContext on the client
        return id(spark)


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The driver's table ``name``; the relation is resolved once per session
    (file listing and footer read), then reused by every adapter."""
    key = (_session_key(spark), sf_dir, name)
    if key not in _READS:
        _READS[key] = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return _READS[key]


def dealt(df: DataFrame, key: str) -> DataFrame:
    """Rows dealt by ``key`` over some four tasks a core, whatever the file's layout: a scan has no more tasks than the
    file has row groups. A fixed number, as run-time merging goes by bytes, and here small rows take long to work on."""
    spark = df.sparkSession
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    try:
        tasks = min(tasks, max(4 * spark.sparkContext.defaultParallelism, 32))
    except Exception:  # Spark Connect: no SparkContext on the client
        pass
    return df.repartition(tasks, key)


# --- shared column rules over the event base relation ------------------------
# base columns: event_id, ts (timestamp), user_id, event_type, value, k
TENANT = "'t' || cast(user_id % 4 as string)"
NODE = "event_type || '-' || cast(k as string)"
LOGIN = "case when user_id % 13 = 0 then null else 'u' || cast((user_id + k) % 9 as string) end"
ORG = "case when k % 5 = 0 then null else 'org' || cast(k % 2 as string) end"
REPO = "case when k % 7 = 0 then null else 'r' || cast(k % 4 as string) end"
EARLIER = "ts - interval 1 hour * (k % 50)"
EMAIL = "case when user_id % 6 = 0 then null else 'p' || cast(user_id % 11 as string) || '@x.io' end"

# resource -> (source, resource_type, [(json path, kind, rule)])
# kinds: str, int, num, bool, ts, obj (key present when rule true), arr_id
RESOURCES: dict[str, tuple[str, str, list[tuple[str, str, str]]]] = {
    "pull_requests": ("github", "pull_requests", [
        ("node_id", "str", f"case when k % 11 = 0 and event_type = 'view' then null else {NODE} end"),
        ("number", "int", "k"),
        ("title", "str", "case when value < 3 then 'Revert \"feature ' || cast(k as string) || '\"' "
                         "when value < 6 then 'revert: fix' when value < 9 then 'Reverting things' "
                         "when value < 10 then 'REVERT' when value < 11 then null "
                         "else event_type || ' change ' || cast(k as string) end"),
        ("state", "str", "case when event_type in ('purchase', 'signup') then 'closed' else 'open' end"),
        ("created_at", "ts", f"case when value < 1 then null else {EARLIER} end"),
        ("closed_at", "ts", "case when event_type in ('purchase', 'signup') then ts end"),
        ("merged_at", "ts", "case when event_type = 'purchase' then ts - interval 1 minute * (user_id % 7) end"),
        ("user.login", "str", LOGIN),
        ("base.repo.full_name", "str", "case when k % 3 = 0 then 'full/' || cast(k % 4 as string) end"),
        ("org", "str", ORG),
        ("repo", "str", REPO),
    ]),
    "reviews": ("github", "reviews", [
        ("node_id", "str", NODE),
        ("id", "int", "k * 1000 + user_id"),
        ("state", "str", "case when event_type = 'view' then 'PENDING' when event_type = 'error' "
                         "then 'CHANGES_REQUESTED' when value < 10 then null else 'APPROVED' end"),
        ("submitted_at", "ts", "case when event_type = 'click' and user_id % 5 = 0 then null else ts end"),
        ("user.login", "str", LOGIN),
        ("pull_request_number", "int", "k % 40"),
        ("org", "str", ORG),
        ("repo", "str", REPO),
    ]),
    "releases": ("github", "releases", [
        ("node_id", "str", NODE),
        ("id", "int", "k"),
        ("tag_name", "str", "'v' || cast(k as string)"),
        ("name", "str", "'Release ' || cast(k as string)"),
        ("draft", "bool", "case when k % 10 = 0 then true when k % 10 = 1 then null else false end"),
        ("prerelease", "bool", "case when k % 3 = 0 then true when k % 3 = 1 then false end"),
        ("created_at", "ts", "ts - interval 1 hour"),
        ("published_at", "ts", "case when event_type = 'view' then null else ts end"),
        ("author.login", "str", LOGIN),
        ("org", "str", ORG),
        ("repo", "str", REPO),
    ]),
    "issues": ("github", "issues", [
        ("node_id", "str", NODE),
        ("number", "int", "k"),
        ("title", "str", "'Issue ' || cast(k as string)"),
        ("state", "str", "case when event_type in ('purchase', 'error') then 'closed' else 'open' end"),
        ("state_reason", "str", "case when event_type = 'error' then 'not_planned' "
                                "when event_type = 'purchase' then 'completed' end"),
        ("created_at", "ts", EARLIER),
        ("updated_at", "ts", "ts"),
        ("closed_at", "ts", "case when event_type in ('purchase', 'error') then ts end"),
        ("user.login", "str", LOGIN),
        ("assignee.login", "str", "case when k % 4 = 0 then null else 'a' || cast(k % 6 as string) end"),
        ("html_url", "str", "'https://example.invalid/i/' || cast(k as string)"),
        ("org", "str", ORG),
        ("repo", "str", REPO),
        ("pull_request", "obj", "k % 6 = 0"),
    ]),
    "issue_comments": ("github", "issue_comments", [
        ("node_id", "str", NODE),
        ("id", "int", "k * 7 + user_id"),
        ("created_at", "ts", "case when value < 2 then null else ts end"),
        ("updated_at", "ts", "ts + interval 5 minute"),
        ("user.login", "str", LOGIN),
        ("issue_number", "int", "k % 25"),
        ("org", "str", ORG),
        ("repo", "str", REPO),
    ]),
    "pull_request_review_comments": ("github", "pull_request_review_comments", [
        ("node_id", "str", NODE),
        ("id", "int", "k * 13 + user_id"),
        ("created_at", "ts", "case when value < 2 then null else ts end"),
        ("updated_at", "ts", "ts"),
        ("user.login", "str", LOGIN),
        ("pull_request_number", "int", "k % 40"),
        ("pull_request_review_id", "int", "k * 1000 + user_id"),
        ("path", "str", "'src/f' || cast(k % 8 as string) || '.py'"),
        ("org", "str", ORG),
        ("repo", "str", REPO),
    ]),
    "workflow_runs": ("github", "workflow_runs", [
        ("node_id", "str", NODE),
        ("id", "int", "event_id"),
        ("name", "str", "'ci-' || cast(k % 3 as string)"),
        ("status", "str", "case when event_type = 'view' then 'in_progress' when event_type = 'click' "
                          "then 'Completed' else 'completed' end"),
        ("conclusion", "str", "case when value < 20 then 'success' when value < 30 then 'FAILURE' "
                              "when value < 40 then 'timed_out' when value < 50 then 'cancelled' "
                              "when value < 60 then null else 'Success' end"),
        ("event", "str", "'push'"),
        ("run_number", "int", "k"),
        ("created_at", "ts", EARLIER),
        ("updated_at", "ts", "ts"),
        ("actor.login", "str", LOGIN),
        ("triggering_actor.login", "str", "'bot' || cast(k % 2 as string)"),
        ("head_branch", "str", "'main'"),
        ("head_sha", "str", "'sha' || cast(k as string)"),
        ("org", "str", ORG),
        ("repo", "str", REPO),
    ]),
    "linear_issues": ("linear", "issues", [
        ("id", "str", NODE),
        ("identifier", "str", "'ENG-' || cast(k as string)"),
        ("title", "str", "'Ticket ' || cast(k as string)"),
        ("state.name", "str", "case when event_type = 'purchase' then 'Done' when event_type = 'error' "
                              "then 'Canceled' when event_type = 'click' then 'In Progress' end"),
        ("state.type", "str", "case when event_type = 'purchase' then 'completed' when event_type = 'error' "
                              "then 'canceled' when event_type = 'click' then 'started' else 'backlog' end"),
        ("createdAt", "ts", EARLIER),
        ("updatedAt", "ts", "ts"),
        ("completedAt", "ts", "case when event_type = 'purchase' then ts end"),
        ("canceledAt", "ts", "case when event_type = 'error' then ts end"),
        ("priority", "int", "k % 5"),
        ("estimate", "num", "case when k % 4 = 0 then null else value end"),
        ("url", "str", "'https://linear.invalid/' || cast(k as string)"),
        ("team.key", "str", "'T' || cast(k % 3 as string)"),
        ("creator.email", "str", EMAIL),
        ("creator.displayName", "str", "case when user_id % 4 = 0 then null else 'Disp' || cast(user_id % 5 as string) end"),
        ("creator.name", "str", "'Name' || cast(user_id % 7 as string)"),
        ("assignee.email", "str", "case when k % 3 = 0 then null else 'as' || cast(k % 5 as string) || '@x.io' end"),
        ("assignee.name", "str", "case when k % 2 = 0 then 'Asg' || cast(k % 4 as string) end"),
    ]),
    "linear_comments": ("linear", "comments", [
        ("id", "str", NODE),
        ("body", "str", "'comment ' || cast(event_id as string)"),
        ("createdAt", "ts", "case when value < 2 then null else ts end"),
        ("updatedAt", "ts", "ts"),
        ("editedAt", "ts", "case when k % 5 = 0 then ts end"),
        ("issueId", "str", "case when k % 2 = 0 then 'iss-' || cast(k % 30 as string) end"),
        ("issue.id", "str", "'issue-' || cast(k % 30 as string)"),
        ("issue.identifier", "str", "'ENG-' || cast(k % 30 as string)"),
        ("project.id", "str", "case when k % 3 = 0 then 'prj-' || cast(k % 4 as string) end"),
        ("user.id", "str", "case when user_id % 3 = 0 then null else 'uid' || cast(user_id % 10 as string) end"),
        ("user.email", "str", EMAIL),
        ("externalUser.id", "str", "'ext' || cast(user_id % 2 as string)"),
    ]),
    "linear_projects": ("linear", "projects", [
        ("id", "str", NODE),
        ("name", "str", "'Project ' || cast(k as string)"),
        ("url", "str", "'https://linear.invalid/p/' || cast(k as string)"),
        ("createdAt", "ts", "case when value < 2 then null else " + EARLIER + " end"),
        ("updatedAt", "ts", "ts"),
        ("startedAt", "ts", "case when event_type <> 'view' then ts - interval 30 minute end"),
        ("completedAt", "ts", "case when event_type = 'purchase' then ts end"),
        ("canceledAt", "ts", "case when event_type = 'error' then ts end"),
        ("status.name", "str", "case when event_type = 'purchase' then 'Completed' else 'Planned' end"),
        ("status.type", "str", "case when event_type = 'purchase' then 'completed' else 'planned' end"),
        ("lead.id", "str", "case when k % 2 = 0 then 'lead' || cast(k % 5 as string) end"),
        ("lead.email", "str", EMAIL),
    ]),
    "linear_description_edits": ("linear", "issue_description_edits", [
        ("id", "str", NODE),
        ("createdAt", "ts", "ts"),
        ("updatedDescription", "bool", "case when event_type = 'view' then false when event_type = 'click' "
                                       "then null else true end"),
        ("issue.id", "str", "case when k % 4 = 0 then null else 'issue-' || cast(k % 30 as string) end"),
        ("issueId", "str", "'iss-' || cast(k % 30 as string)"),
        ("issue.identifier", "str", "'ENG-' || cast(k % 30 as string)"),
        ("descriptionUpdatedBy", "arr_id", "case when k % 3 = 0 then null else 'ed' || cast(k % 7 as string) end"),
        ("actor.id", "str", "case when user_id % 2 = 0 then 'act' || cast(user_id % 5 as string) end"),
        ("actor.email", "str", EMAIL),
    ]),
    "copilot_usage": ("github", "copilot_usage", [
        ("day", "str", "cast(cast(ts as date) as string)"),
        ("user_login", "str", "case when user_id % 5 = 0 then null else 'u' || cast(user_id % 9 as string) end"),
        ("org", "str", "case when k % 10 = 0 then null else 'org' || cast(k % 2 as string) end"),
        ("total_suggestions_count", "int", "k"),
        ("total_acceptances_count", "int", "user_id % 7"),
    ]),
}

ISO_TS = "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'"


def flat_name(path: str) -> str:
    return path.replace(".", "_")


def _json_value_sql(kind: str, rule: str) -> str:
    if kind == "ts":
        return f"date_format(cast(({rule}) as timestamp), \"{ISO_TS}\")"
    if kind == "obj":
        return f"case when ({rule}) then named_struct('url', 'x') end"
    if kind == "arr_id":
        return f"case when ({rule}) is not null then array(named_struct('id', ({rule}))) end"
    if kind == "int":
        return f"cast(({rule}) as bigint)"
    if kind == "num":
        return f"cast(({rule}) as double)"
    return f"({rule})"


def _struct_sql(fields: list[tuple[str, str, str]]) -> str:
    """Nested ``named_struct`` SQL from dotted paths (shared prefixes merge)."""
    tree: dict = {}
    for path, kind, rule in fields:
        node = tree
        parts = path.split(".")
        for p in parts[:-1]:
            node = node.setdefault(p, {})
        node[parts[-1]] = _json_value_sql(kind, rule)

    def emit(node: dict) -> str:
        args = []
        for name, v in node.items():
            args.append(f"'{name}'")
            args.append(emit(v) if isinstance(v, dict) else v)
        return "named_struct(" + ", ".join(args) + ")"

    return emit(tree)


def event_base(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events dealt by id: the JSON work on an event outweighs its move."""
    ev = dealt(read_table(spark, sf_dir, "events"), "event_id")
    return ev.select(
        "event_id", F.col("ts").cast("timestamp").alias("ts"), "user_id", "event_type", "value",
        F.get_json_object("props", "$.k").cast("bigint").alias("k"),
    )


def fx_raw_resource(spark: SparkSession, sf_dir: str, resource: str) -> DataFrame:
    """Every event becomes one landed snapshot of ``resource``.

    Key = (tenant, event_type-k): about 2,000 keys with many snapshots each.
    The (lazy) DataFrame is built once per session and reused.
    """
    key = (_session_key(spark), sf_dir, "raw:" + resource)
    if key not in _READS:
        _READS[key] = _fx_raw_resource(spark, sf_dir, resource)
    return _READS[key]


def _fx_raw_resource(spark: SparkSession, sf_dir: str, resource: str) -> DataFrame:
    source, rtype, fields = RESOURCES[resource]
    base = event_base(spark, sf_dir)
    payload = F.to_json(F.expr(_struct_sql(fields)))
    idx = list(RESOURCES).index(resource)
    return base.select(
        (F.col("event_id") * 100 + idx).alias("id"),
        F.expr(TENANT).alias("tenant_id"),
        F.lit(source).alias("source"),
        F.lit(rtype).alias("resource_type"),
        F.col("k").cast("string").alias("source_id"),
        payload.alias("payload"),
        F.col("ts").alias("fetched_at"),
        (F.col("event_id") / 500).cast("bigint").alias("run_id"),
    )


def fx_raw_all(spark: SparkSession, sf_dir: str, resources=None) -> DataFrame:
    """All resources landed into one raw table (union of per-resource adapters)."""
    key = (_session_key(spark), sf_dir, "raw_all:" + ",".join(resources or RESOURCES))
    if key in _READS:
        return _READS[key]
    out = None
    for r in resources or RESOURCES:
        d = fx_raw_resource(spark, sf_dir, r)
        out = d if out is None else out.unionByName(d)
    _READS[key] = out
    return out


def fx_raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FIXTURES ``fx_raw``: payload = props, resource_type = event_type."""
    ev = read_table(spark, sf_dir, "events")
    return ev.select(
        F.col("event_id").alias("id"),
        F.concat(F.lit("t"), (F.col("user_id") % 4).cast("string")).alias("tenant_id"),
        F.lit("github").alias("source"),
        F.col("event_type").alias("resource_type"),
        F.get_json_object("props", "$.k").alias("source_id"),
        F.col("props").alias("payload"),
        F.col("ts").cast("timestamp").alias("fetched_at"),
        (F.col("event_id") / 500).cast("bigint").alias("run_id"),
    )


# --- order-based adapters: pull requests and reviews ------------------------
REVERT_LIKE = r"(?i)^economy([\s\p{Punct}]|$)"


def fx_pr(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Staging-shaped pull requests from orders (one PR per order)."""
    o = read_table(spark, sf_dir, "orders")
    c = read_table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey")
    li = read_table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_shipdate")
    p = read_table(spark, sf_dir, "part").select("p_partkey", "p_type")
    li = li.repartition("l_orderkey")  # else a scan task groups all orders of its row groups at once
    per_order = (li.join(p, li.l_partkey == p.p_partkey, "left")
                 .groupBy("l_orderkey")
                 .agg(F.max("l_shipdate").alias("last_ship"), F.min("p_type").alias("title")))
    j = (o.join(c, o.o_custkey == c.c_custkey, "left")
         .join(per_order, o.o_orderkey == per_order.l_orderkey, "left"))
    created = F.col("o_orderdate").cast("timestamp")
    last = F.col("last_ship").cast("timestamp")
    merged = F.when(F.col("o_orderstatus") == "F", last)
    return j.select(
        F.col("c_nationkey").cast("string").alias("tenant_id"),
        F.col("o_orderkey").cast("string").alias("pr_node_id"),
        F.col("o_orderkey").alias("pr_number"),
        F.col("title"),
        F.when(F.col("o_orderstatus") == "O", "open").otherwise("closed").alias("state"),
        created.alias("created_at"),
        F.when(F.col("o_orderstatus") != "O", last).alias("closed_at"),
        merged.alias("merged_at"),
        F.when(merged.isNotNull(),
               (F.unix_micros(merged) - F.unix_micros(created)) / F.lit(3.6e9)).alias("cycle_time_hours"),
        F.coalesce(F.col("title"), F.lit("")).rlike(REVERT_LIKE).alias("is_revert"),
        F.col("o_custkey").cast("string").alias("author_login"),
        F.when(F.col("o_orderkey") % 97 == 0, F.lit(None).cast("string"))
         .otherwise(F.col("o_orderpriority")).alias("repo"),
        created.alias("fetched_at"),
    )


def fx_review(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Staging-shaped submitted reviews from line items (pending ones dropped)."""
    li = read_table(spark, sf_dir, "lineitem")
    o = read_table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderpriority")
    c = read_table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey")
    j = (li.where(F.col("l_returnflag") != "N")
         .join(o, li.l_orderkey == o.o_orderkey, "inner")
         .join(c, o.o_custkey == c.c_custkey, "left"))
    return j.select(
        F.col("c_nationkey").cast("string").alias("tenant_id"),
        F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey").alias("review_node_id"),
        F.col("l_partkey").alias("review_id"),
        F.when(F.col("l_returnflag") == "A", "APPROVED").otherwise("COMMENTED").alias("state"),
        F.col("l_shipdate").cast("timestamp").alias("submitted_at"),
        F.col("l_suppkey").cast("string").alias("reviewer_login"),
        F.col("l_orderkey").alias("pull_request_number"),
        F.when(F.col("o_orderkey") % 97 == 0, F.lit(None).cast("string"))
         .otherwise(F.col("o_orderpriority")).alias("repo"),
        F.col("l_shipdate").cast("timestamp").alias("fetched_at"),
    )


def fx_incident(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Incidents for the MTTR spec: one per line item (service = return flag)."""
    li = read_table(spark, sf_dir, "lineitem")
    o = read_table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderdate")
    c = read_table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey")
    j = li.join(o, li.l_orderkey == o.o_orderkey).join(c, o.o_custkey == c.c_custkey, "left")
    return j.select(
        F.col("c_nationkey").cast("string").alias("tenant_id"),
        F.concat_ws("-", "l_orderkey", "l_linenumber").alias("id"),
        F.col("l_returnflag").alias("service"),
        F.col("o_orderdate").cast("timestamp").alias("started_at"),
        F.when(F.col("l_linestatus") == "F", F.col("l_shipdate").cast("timestamp")).alias("resolved_at"),
    )


def fx_enroll(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Enrollment per tenant from ``nation``: odd keys explicit, params by rule."""
    n = read_table(spark, sf_dir, "nation")
    k = F.col("n_nationkey")
    return n.select(
        k.cast("string").alias("tenant_id"),
        F.when(k % 2 == 1, "explicit").otherwise("default_on").alias("mode"),
        F.when(k % 2 == 1, F.array(F.lit("std.merged_prs"), F.lit("std.cycle_time"))).alias("enabled"),
        F.when(k % 4 == 0, F.array(F.lit("std.cycle_time_p90"))).alias("disabled"),
        F.when(k % 5 == 0, F.array(F.lit("t.custom"))).alias("custom"),
        (k % 3 == 0).alias("include_prereleases"),
        F.when(k % 7 != 0, (k % 3).cast("int")).alias("min_reviews"),
    )


def fx_roster(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Org members (identity roster) from ``customer``."""
    c = read_table(spark, sf_dir, "customer")
    return c.select(
        F.col("c_nationkey").cast("string").alias("tenant_id"),
        F.col("c_custkey").cast("string").alias("external_id"),
        F.col("c_name").alias("login"),
        F.when(F.col("c_custkey") % 11 == 0, F.lit(None).cast("string"))
         .otherwise(F.concat(F.lit("u"), (F.col("c_custkey") % 150).cast("string"), F.lit("@x"))).alias("email"),
    )


def fx_users(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Product users from ``supplier``."""
    s = read_table(spark, sf_dir, "supplier")
    return s.select(
        F.col("s_suppkey").cast("string").alias("user_id"),
        F.when(F.col("s_suppkey") < 50, F.col("s_suppkey").cast("string")).alias("oauth_id"),
        F.concat(F.lit("U"), F.col("s_suppkey").cast("string"), F.lit("@X")).alias("email"),
    )


def fx_identity_raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Org-member and user-profile landings from ``customer``, two snapshots each
    (the older one carries stale values)."""
    c = read_table(spark, sf_dir, "customer")
    k = F.col("c_custkey")
    snaps = c.select("*", F.explode(F.array(F.lit(0), F.lit(1))).alias("v"))
    tenant = F.col("c_nationkey").cast("string")
    fetched = (F.lit("2024-01-01 00:00:00").cast("timestamp") + F.make_interval(
        F.lit(0), F.lit(0), F.lit(0), F.col("v").cast("int"), F.lit(0), F.lit(0), F.lit(0)))
    members = snaps.select(
        (k * 10 + F.col("v")).alias("id"), tenant.alias("tenant_id"), F.lit("github").alias("source"),
        F.lit("organization_members").alias("resource_type"),
        F.to_json(F.struct(F.when(k % 17 != 0, k).alias("id"), F.col("c_name").alias("login"),
                           F.concat(F.lit("a"), F.col("v").cast("string")).alias("avatar_url"))).alias("payload"),
        fetched.alias("fetched_at"))
    email = (F.when(F.col("v") == 0, F.concat(F.lit("stale"), k.cast("string"), F.lit("@x")))
             .when(k % 13 == 0, F.lit("")).when(k % 11 == 0, F.lit(None))
             .otherwise(F.concat(F.lit("U"), (k % 150).cast("string"), F.lit("@x"))))
    profiles = snaps.select(
        (k * 10 + 5 + F.col("v")).alias("id"), tenant.alias("tenant_id"), F.lit("github").alias("source"),
        F.lit("user_profiles").alias("resource_type"),
        F.to_json(F.struct(F.col("c_name").alias("login"), email.alias("email"),
                           F.when(k % 7 == 0, F.lit("")).otherwise(F.concat(F.lit("Name "), k.cast("string")))
                           .alias("name"))).alias("payload"),
        fetched.alias("fetched_at"))
    return members.unionByName(profiles)


def fx_admins(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = read_table(spark, sf_dir, "customer")
    return c.where(F.col("c_acctbal") > 9000).select(F.col("c_nationkey").cast("string").alias("tenant_id"),
                                                      F.col("c_name").alias("login"))


def fx_existing_identities(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = read_table(spark, sf_dir, "customer").where(F.col("c_custkey") % 3 == 0)
    k = F.col("c_custkey")
    linked = k % 6 == 0
    return c.select(
        F.col("c_nationkey").cast("string").alias("tenant_id"), k.cast("string").alias("external_user_id"),
        F.concat(F.lit("old_"), F.col("c_name")).alias("login"),
        F.when(k % 2 == 0, F.concat(F.lit("keep"), k.cast("string"), F.lit("@x"))).alias("email"),
        F.concat(F.lit("Old "), k.cast("string")).alias("name"), F.lit("member").alias("org_role"),
        F.when(linked, (k % 40).cast("string")).alias("user_id"),
        F.when(linked, F.lit("email")).alias("link_method"),
        F.when(linked, F.lit("linked")).otherwise(F.lit("pending_email")).alias("status"))


def fx_memberships(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = fx_existing_identities(spark, sf_dir).where(F.col("user_id").isNotNull())
    k = F.col("external_user_id").cast("bigint")
    return e.select("tenant_id", "user_id",
                    F.when(k % 12 == 0, "admin").when(k % 18 == 0, "manager").otherwise("individual").alias("role")
                    ).groupBy("tenant_id", "user_id").agg(F.min("role").alias("role"))


def fx_signups(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = read_table(spark, sf_dir, "supplier")
    k = F.col("s_suppkey")
    return s.select(F.concat(F.lit("new"), k.cast("string")).alias("user_id"),
                    (k * 11).cast("string").alias("oauth_id"),
                    F.concat(F.lit("U"), (k + 7).cast("string"), F.lit("@X")).alias("email"))


def fx_runlog(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ingestion run log from ``orders``."""
    o = read_table(spark, sf_dir, "orders")
    st = F.col("o_orderstatus")
    status = F.when(st == "F", "success").when(st == "P", "error").otherwise("running")
    started = F.col("o_orderdate").cast("timestamp") + F.make_interval(
        F.lit(0), F.lit(0), F.lit(0), F.lit(0), F.lit(0), F.lit(0), (F.col("o_orderkey") % 86400).cast("decimal(18,6)"))
    return o.select(
        F.col("o_orderkey").alias("id"),
        F.concat(F.lit("t"), (F.col("o_custkey") % 4).cast("string")).alias("tenant_id"),
        (F.col("o_custkey") % 20).cast("string").alias("connected_account_id"),
        F.col("o_orderpriority").alias("resource_type"),
        started.alias("started_at"), status.alias("status"),
        F.when(st == "F", F.col("o_orderdate").cast("timestamp") + F.expr("INTERVAL 12 HOURS")).alias("watermark"))


def fx_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Paged issue documents (at most 50 nodes per page) with edit histories."""
    b = event_base(spark, sf_dir)
    iso = F.date_format("ts", ISO_TS)
    h1 = F.struct(F.concat(F.lit("e"), F.col("event_id").cast("string")).alias("id"),
                  (F.col("value") > 20).alias("updatedDescription"), iso.alias("createdAt"))
    h2 = F.struct(F.when(F.col("k") % 3 != 0, F.concat(F.lit("f"), F.col("event_id").cast("string"))).alias("id"),
                  F.lit(True).alias("updatedDescription"), iso.alias("createdAt"))
    node = F.struct(F.concat(F.lit("iss-"), F.col("event_id").cast("string")).alias("id"),
                    F.concat(F.lit("ENG-"), F.col("k").cast("string")).alias("identifier"),
                    F.concat(F.lit("https://linear.invalid/"), F.col("event_id").cast("string")).alias("url"),
                    iso.alias("updatedAt"),
                    F.struct(F.array(h1, h2).alias("nodes")).alias("history"))
    pages = (b.select(F.expr(TENANT).alias("tenant_id"), (F.col("event_id") / 50).cast("bigint").alias("page_id"),
                      node.alias("n"))
             .groupBy("tenant_id", "page_id").agg(F.array_sort(F.collect_list("n")).alias("nodes")))
    doc = F.to_json(F.struct(F.struct(F.struct(F.col("nodes").alias("nodes")).alias("issues")).alias("data")))
    return pages.select("tenant_id", "page_id", doc.alias("doc"))
