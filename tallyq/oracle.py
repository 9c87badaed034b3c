"""DuckDB oracle SQL, written from the reference semantics (not from our plans).

Staging uses ``row_number`` over the landed rows (``distinct on`` in the
reference), rolling windows use the literal range join on a step spine, and
dimensions use ``grouping sets``. Payload fields appear as typed columns
``p_<path>`` (dots become underscores).
"""

from __future__ import annotations

from tallyspark.fixtures import RESOURCES, TENANT, flat_name

EV = ("select event_id, ts, user_id, event_type, value, "
      "cast(json_extract_string(props, '$.k') as bigint) as k from events")


def src_sql(resource: str) -> str:
    """Typed columns of every landed snapshot of ``resource`` (no JSON)."""
    _, _, fields = RESOURCES[resource]
    cols = []
    for path, kind, rule in fields:
        name = "p_" + flat_name(path)
        if kind == "int":
            cols.append(f"cast(({rule}) as bigint) as {name}")
        elif kind == "num":
            cols.append(f"cast(({rule}) as double) as {name}")
        elif kind == "obj":
            cols.append(f"coalesce(({rule}), false) as {name}")
        else:
            cols.append(f"({rule}) as {name}")
    idx = list(RESOURCES).index(resource)
    return (f"select {TENANT} as tenant_id, event_id * 100 + {idx} as id, ts as fetched_at, "
            f"event_id // 500 as run_id, "
            + ", ".join(cols) + f" from ({EV}) ev")


def latest(resource: str, key: str, where: str = "true") -> str:
    return (f"select * from ({src_sql(resource)}) s where {key} is not null and ({where}) "
            f"qualify row_number() over (partition by tenant_id, {key} "
            f"order by fetched_at desc, id desc) = 1")


REPO = "nullif(concat(p_org, '/', p_repo), '/')"


def stg(resource: str) -> str:
    if resource == "pull_requests":
        return f"""
select tenant_id, p_node_id as pr_node_id, cast(p_number as integer) as pr_number, p_title as title,
  p_state as state, p_created_at as created_at, p_closed_at as closed_at, p_merged_at as merged_at,
  case when p_merged_at is not null and p_created_at is not null
       then (epoch_us(p_merged_at) - epoch_us(p_created_at)) / 1e6 / 3600.0 end as cycle_time_hours,
  regexp_matches(coalesce(p_title, ''), '^revert([[:space:][:punct:]]|$)', 'i') as is_revert,
  p_user_login as author_login,
  coalesce(p_base_repo_full_name, {REPO}) as repo, fetched_at
from ({latest(resource, 'p_node_id')}) d"""
    if resource == "reviews":
        return f"""
select tenant_id, p_node_id as review_node_id, p_id as review_id, p_state as state,
  p_submitted_at as submitted_at, p_user_login as reviewer_login,
  cast(p_pull_request_number as integer) as pull_request_number, {REPO} as repo, fetched_at
from ({latest(resource, 'p_node_id', "p_submitted_at is not null and coalesce(p_state, '') <> 'PENDING'")}) d"""
    if resource == "releases":
        return f"""
select tenant_id, p_node_id as release_node_id, p_id as release_id, p_tag_name as tag_name,
  p_name as release_name, coalesce(p_draft, false) as is_draft, coalesce(p_prerelease, false) as is_prerelease,
  p_created_at as created_at, p_published_at as published_at, p_author_login as author_login,
  {REPO} as repo, fetched_at
from ({latest(resource, 'p_node_id')}) d"""
    if resource == "issues":
        return f"""
select tenant_id, p_node_id as issue_node_id, cast(p_number as integer) as issue_number, p_title as title,
  p_state as state, p_state_reason as state_reason, p_created_at as created_at,
  p_updated_at as updated_at, p_closed_at as closed_at, p_user_login as author_login,
  p_assignee_login as assignee_login, p_html_url as html_url, {REPO} as repo, fetched_at
from ({latest(resource, 'p_node_id', 'not p_pull_request')}) d"""
    if resource == "issue_comments":
        return f"""
select tenant_id, p_node_id as comment_node_id, p_id as comment_id, p_created_at as created_at,
  p_updated_at as updated_at, p_user_login as author_login,
  cast(p_issue_number as integer) as issue_number, {REPO} as repo, fetched_at
from ({latest(resource, 'p_node_id', 'p_created_at is not null')}) d"""
    if resource == "pull_request_review_comments":
        return f"""
select tenant_id, p_node_id as comment_node_id, p_id as comment_id, p_created_at as created_at,
  p_updated_at as updated_at, p_user_login as author_login,
  cast(p_pull_request_number as integer) as pull_request_number,
  p_pull_request_review_id as pull_request_review_id, p_path as file_path, {REPO} as repo, fetched_at
from ({latest(resource, 'p_node_id', 'p_created_at is not null')}) d"""
    if resource == "workflow_runs":
        return f"""
select tenant_id, p_node_id as run_node_id, p_id as run_id, p_name as workflow_name,
  p_status as run_status, p_conclusion as conclusion, p_event as trigger_event,
  cast(p_run_number as integer) as run_number, p_created_at as created_at, p_updated_at as updated_at,
  coalesce(p_actor_login, p_triggering_actor_login) as actor_login, p_head_branch as head_branch,
  p_head_sha as head_sha, {REPO} as repo, fetched_at
from ({latest(resource, 'p_node_id')}) d"""
    if resource == "linear_issues":
        return f"""
select tenant_id, p_id as issue_id, p_identifier as identifier, p_title as title,
  p_state_name as state_name, p_state_type as state_type, p_createdAt as created_at,
  p_updatedAt as updated_at, p_completedAt as completed_at, p_canceledAt as canceled_at,
  cast(p_priority as integer) as priority, cast(p_estimate as decimal(18,4)) as estimate, p_url as url,
  p_team_key as team_key,
  coalesce(p_creator_email, p_creator_displayName, p_creator_name) as creator,
  coalesce(p_assignee_email, p_assignee_name) as assignee, fetched_at
from ({latest(resource, 'p_id')}) d"""
    if resource == "linear_comments":
        return f"""
select tenant_id, p_id as comment_id, p_createdAt as created_at, p_updatedAt as updated_at,
  p_editedAt as edited_at, coalesce(p_issueId, p_issue_id) as issue_id,
  p_issue_identifier as issue_identifier, p_project_id as project_id,
  coalesce(p_user_id, p_user_email, p_externalUser_id) as author_id, fetched_at
from ({latest(resource, 'p_id')}) d"""
    if resource == "linear_projects":
        return f"""
select tenant_id, p_id as project_id, p_name as project_name, p_url as url,
  p_createdAt as created_at, p_updatedAt as updated_at, p_startedAt as started_at,
  p_completedAt as completed_at, p_canceledAt as canceled_at, p_status_name as status_name,
  p_status_type as status_type, coalesce(p_lead_id, p_lead_email) as lead_id, fetched_at
from ({latest(resource, 'p_id')}) d"""
    if resource == "linear_description_edits":
        return f"""
select tenant_id, p_id as edit_id, p_createdAt as edited_at, coalesce(p_issue_id, p_issueId) as issue_id,
  p_issue_identifier as issue_identifier,
  coalesce(p_descriptionUpdatedBy, p_actor_id, p_actor_email) as editor_id, fetched_at
from ({latest(resource, 'p_id', 'coalesce(p_updatedDescription, false)')}) d"""
    raise KeyError(resource)


# --- order-based adapters ---------------------------------------------------------
FX_PR = """
select cast(c.c_nationkey as varchar) as tenant_id, cast(o.o_orderkey as varchar) as pr_node_id,
  o.o_orderkey as pr_number, po.title,
  case when o.o_orderstatus = 'O' then 'open' else 'closed' end as state,
  o.o_orderdate as created_at,
  case when o.o_orderstatus <> 'O' then po.last_ship end as closed_at,
  case when o.o_orderstatus = 'F' then po.last_ship end as merged_at,
  case when o.o_orderstatus = 'F' and po.last_ship is not null
       then (epoch_us(po.last_ship) - epoch_us(o.o_orderdate)) / 3.6e9 end as cycle_time_hours,
  regexp_matches(coalesce(po.title, ''), '^economy([[:space:][:punct:]]|$)', 'i') as is_revert,
  cast(o.o_custkey as varchar) as author_login,
  case when o.o_orderkey % 97 = 0 then null else o.o_orderpriority end as repo,
  o.o_orderdate as fetched_at
from orders o left join customer c on o.o_custkey = c.c_custkey
left join (select l_orderkey, max(l_shipdate) as last_ship, min(p_type) as title
           from lineitem left join part on l_partkey = p_partkey group by l_orderkey) po
  on o.o_orderkey = po.l_orderkey"""

FX_REVIEW = """
select cast(c.c_nationkey as varchar) as tenant_id,
  concat_ws('-', l_orderkey, l_linenumber, l_partkey, l_suppkey) as review_node_id,
  l_partkey as review_id,
  case when l_returnflag = 'A' then 'APPROVED' else 'COMMENTED' end as state,
  l_shipdate as submitted_at, cast(l_suppkey as varchar) as reviewer_login,
  l_orderkey as pull_request_number,
  case when o_orderkey % 97 = 0 then null else o_orderpriority end as repo,
  l_shipdate as fetched_at
from lineitem join orders on l_orderkey = o_orderkey left join customer c on o_custkey = c.c_custkey
where l_returnflag <> 'N'"""

REVIEW_MATCH = """p.tenant_id = r.tenant_id and r.repo is not distinct from p.repo
  and p.pr_number = r.pull_request_number
  and (p.author_login is null or r.reviewer_login is distinct from p.author_login)"""

FIRST_REVIEW = f"""
select p.tenant_id, p.pr_node_id, min(r.submitted_at) as first_review_at,
  cast(count(r.review_node_id) as integer) as review_count
from ({FX_PR}) p left join ({FX_REVIEW}) r on {REVIEW_MATCH}
group by p.tenant_id, p.pr_node_id"""

PR_ENTITY = f"""
select p.tenant_id, p.pr_node_id as id, p.repo, p.author_login as author_id,
  case when p.merged_at is not null then 'merged' when p.state = 'closed' then 'closed' else 'open' end as state,
  cast(null as integer) as additions, cast(null as integer) as deletions,
  cast(coalesce(f.review_count, 0) as integer) as review_count, p.is_revert,
  p.created_at as opened_at, f.first_review_at, p.merged_at, p.closed_at, p.fetched_at
from ({FX_PR}) p left join ({FIRST_REVIEW}) f on p.tenant_id = f.tenant_id and p.pr_node_id = f.pr_node_id"""

FX_INCIDENT = """
select cast(c.c_nationkey as varchar) as tenant_id, concat_ws('-', l_orderkey, l_linenumber) as id,
  l_returnflag as service, o_orderdate as started_at,
  case when l_linestatus = 'F' then l_shipdate end as resolved_at
from lineitem join orders on l_orderkey = o_orderkey left join customer c on o_custkey = c.c_custkey"""

RELEASE_ENTITY = f"""
select tenant_id, release_node_id as id, repo, author_login as author_id, tag_name, release_name,
  is_draft, is_prerelease, created_at, published_at, fetched_at from ({stg('releases')}) s"""

# --- identity chain ----------------------------------------------------------------
_SNAP = "(select * from (values (0), (1)) t(v))"
ID_MEMBERS = f"""
select cast(c_nationkey as varchar) as tenant_id, c_custkey * 10 + v as id, c_name as login,
  case when c_custkey % 17 <> 0 then c_custkey end as p_id,
  timestamp '2024-01-01 00:00:00' + v * interval 1 day as fetched_at
from customer, {_SNAP} s"""
ID_PROFILES = f"""
select cast(c_nationkey as varchar) as tenant_id, c_custkey * 10 + 5 + v as id, c_name as login,
  case when v = 0 then 'stale' || cast(c_custkey as varchar) || '@x' when c_custkey % 13 = 0 then ''
       when c_custkey % 11 = 0 then null else 'U' || cast(c_custkey % 150 as varchar) || '@x' end as email,
  case when c_custkey % 7 = 0 then '' else 'Name ' || cast(c_custkey as varchar) end as name,
  timestamp '2024-01-01 00:00:00' + v * interval 1 day as fetched_at
from customer, {_SNAP} s"""


def _latest_login(src):
    return (f"select * from ({src}) x qualify row_number() over (partition by tenant_id, login "
            f"order by fetched_at desc, id desc) = 1")


PROFILES_LATEST = f"select tenant_id, login, email, name from ({_latest_login(ID_PROFILES)}) p"
ROSTER = f"""
select m.tenant_id, cast(m.p_id as varchar) as external_user_id, m.login, nullif(p.email, '') as email,
  nullif(p.name, '') as name,
  case when a.login is not null then 'admin' else 'member' end as org_role
from ({_latest_login(ID_MEMBERS)}) m
left join ({PROFILES_LATEST}) p on m.tenant_id = p.tenant_id and m.login = p.login
left join (select distinct cast(c_nationkey as varchar) as tenant_id, c_name as login from customer
           where c_acctbal > 9000) a on m.tenant_id = a.tenant_id and m.login = a.login
where m.p_id is not null"""
EXISTING = """
select cast(c_nationkey as varchar) as tenant_id, cast(c_custkey as varchar) as external_user_id,
  'old_' || c_name as login, case when c_custkey % 2 = 0 then 'keep' || cast(c_custkey as varchar) || '@x' end as email,
  'Old ' || cast(c_custkey as varchar) as name, 'member' as org_role,
  case when c_custkey % 6 = 0 then cast(c_custkey % 40 as varchar) end as user_id,
  case when c_custkey % 6 = 0 then 'email' end as link_method,
  case when c_custkey % 6 = 0 then 'linked' else 'pending_email' end as status
from customer where c_custkey % 3 = 0"""
J3 = f"""
select coalesce(n.tenant_id, o.tenant_id) as tenant_id, coalesce(n.external_user_id, o.external_user_id) as external_user_id,
  case when n.external_user_id is not null then n.login else o.login end as login,
  coalesce(n.email, o.email) as email, coalesce(n.name, o.name) as name,
  case when n.external_user_id is not null then n.org_role else o.org_role end as org_role,
  o.user_id, o.link_method, coalesce(o.status, 'pending_email') as status
from ({EXISTING}) o full outer join ({ROSTER}) n
  on o.tenant_id = n.tenant_id and o.external_user_id = n.external_user_id"""
_RANK = "case method when 'oauth_id' then 0 when 'email' then 1 else 2 end"
J4 = f"""
with j3 as ({J3}),
by_oauth as (select cast(s_suppkey as varchar) as acc, min(cast(s_suppkey as varchar)) as u
             from supplier where s_suppkey < 50 group by 1),
by_email as (select lower('U' || cast(s_suppkey as varchar) || '@X') as em, min(cast(s_suppkey as varchar)) as u
             from supplier group by 1),
c as (select i.tenant_id, i.external_user_id,
        case when o.u is not null then 'oauth_id' when i.email is not null and e.u is not null then 'email'
             when i.email is not null then 'provisioned' end as method,
        coalesce(o.u, case when i.email is not null then e.u end,
                 case when i.email is not null then 'prov:' || lower(i.email) end) as cand
      from j3 i left join by_oauth o on i.external_user_id = o.acc left join by_email e on lower(i.email) = e.em
      where i.user_id is null),
w as (select * from c where cand is not null
        and not exists (select 1 from j3 l where l.user_id is not null and l.tenant_id = c.tenant_id and l.user_id = c.cand)
      qualify row_number() over (partition by tenant_id, cand order by {_RANK}, external_user_id) = 1)
select i.tenant_id, i.external_user_id, i.login, i.email, i.name, i.org_role,
  case when w.cand is not null then w.cand else i.user_id end as user_id,
  case when w.cand is not null then w.method else i.link_method end as link_method,
  case when w.cand is not null and w.method = 'provisioned' then 'provisioned' when w.cand is not null then 'linked'
       when i.user_id is null and i.email is null then 'pending_email' else i.status end as status
from j3 i left join w on i.tenant_id = w.tenant_id and i.external_user_id = w.external_user_id"""
MEMBERSHIPS = """
select cast(c_nationkey as varchar) as tenant_id, cast(c_custkey % 40 as varchar) as user_id,
  min(case when c_custkey % 12 = 0 then 'admin' when c_custkey % 18 = 0 then 'manager' else 'individual' end) as role
from customer where c_custkey % 6 = 0 group by 1, 2"""
J7 = f"""
select i.tenant_id, i.user_id, min(case when i.org_role = 'admin' then 'admin' else 'individual' end) as role
from ({J4}) i join ({J3}) b on b.tenant_id = i.tenant_id and b.external_user_id = i.external_user_id
where i.user_id is not null and b.user_id is null
  and not exists (select 1 from ({MEMBERSHIPS}) m where m.tenant_id = i.tenant_id and m.user_id = i.user_id)
group by 1, 2"""
J8 = f"""
with mem as ({MEMBERSHIPS} union all select * from ({J7}) a),
ids as (select tenant_id, user_id, arg_min(org_role, external_user_id) as org_role,
          min(external_user_id) as external_user_id from ({J4}) j where user_id is not null group by 1, 2),
a as (select mem.tenant_id, mem.user_id, mem.role, ids.org_role, ids.external_user_id,
        case when ids.org_role = 'admin' and mem.role <> 'admin' then 'admin' else mem.role end as after,
        coalesce(ids.org_role = 'member' and mem.role = 'admin', false) as dc
      from mem left join ids on mem.tenant_id = ids.tenant_id and mem.user_id = ids.user_id),
b as (select *, count(*) filter (where after = 'admin') over (partition by tenant_id) as admins,
        row_number() over (partition by tenant_id, dc order by external_user_id nulls first, user_id) as k from a)
select tenant_id, user_id, case when dc and admins - k >= 1 then 'individual' else after end as role from b"""
J9 = f"""
with j4 as ({J4}), pend as (select * from j4 where user_id is null),
su as (select 'new' || cast(s_suppkey as varchar) as user_id, cast(s_suppkey * 11 as varchar) as oauth_id,
         'U' || cast(s_suppkey + 7 as varchar) || '@X' as email from supplier),
cands as (
  select p.tenant_id, p.external_user_id, s.user_id as cand, 'oauth_id' as method
  from pend p join su s on p.external_user_id = s.oauth_id
  union all
  select p.tenant_id, p.external_user_id, s.user_id, 'email' from pend p join su s on lower(p.email) = lower(s.email)),
c1 as (select * from cands where not exists (select 1 from j4 l where l.user_id is not null
        and l.tenant_id = cands.tenant_id and l.user_id = cands.cand) qualify row_number() over (partition by tenant_id, external_user_id
        order by case when method = 'oauth_id' then 0 else 1 end, cand) = 1),
w as (select * from c1
      qualify row_number() over (partition by tenant_id, cand order by {_RANK}, external_user_id) = 1)
select i.tenant_id, i.external_user_id, i.login, i.email, i.name, i.org_role,
  case when w.cand is not null then w.cand else i.user_id end as user_id,
  case when w.cand is not null then w.method else i.link_method end as link_method,
  case when w.cand is not null then 'linked' else i.status end as status
from j4 i left join w on i.tenant_id = w.tenant_id and i.external_user_id = w.external_user_id"""

# --- envelopes -----------------------------------------------------------------------
GH_NAMES = {"pull_requests": "pull_request", "issues": "issue", "issue_comments": "comment",
            "pull_request_review_comments": "review_comment", "reviews": "review", "releases": "release",
            "workflow_runs": "workflow_run"}
LN_NAMES = {"linear_issues": "issue", "linear_comments": "comment", "linear_projects": "project",
            "linear_description_edits": "description_edit"}


def _cols(resource):
    return {"p_" + flat_name(p) for p, _, _ in RESOURCES[resource][2]}


def _nz(resource, *cols):
    have = _cols(resource)
    parts = [f"nullif(cast({c} as varchar), '')" for c in cols if c in have]
    return parts


def env_sql(resource: str) -> str:
    src = src_sql(resource)
    if resource in GH_NAMES:
        name = GH_NAMES[resource]
        subj = "coalesce(" + ", ".join(_nz(resource, "p_user_login", "p_author_login", "p_actor_login",
                                            "p_triggering_actor_login") + ["'unknown'"]) + ")"
        created = "p_created_at" if "p_created_at" in _cols(resource) else "null"
        occ = {"reviews": "p_submitted_at", "releases": f"coalesce(p_published_at, {created})",
               "workflow_runs": f"coalesce(p_updated_at, {created})"}.get(resource, created)
        natural = "coalesce(" + ", ".join(_nz(resource, "p_id") + ["'None'"]) + ")"
        key = f"coalesce(nullif(p_node_id, ''), '{name}:' || {natural})"
        org_repo = ("case when nullif(p_org, '') is not null and nullif(p_repo, '') is not null "
                    "then p_org || '/' || p_repo end")
        repo = ("coalesce(" + org_repo + (", nullif(p_base_repo_full_name, '')" if "p_base_repo_full_name"
                                           in _cols(resource) else "") + ", p_repo)")
        return (f"select tenant_id, 'github' as source, 'github' as tool, 'event' as kind, '{name}' as name, "
                f"'user' as subject_type, {subj} as subject_id, coalesce({occ}, fetched_at) as occurred_at, "
                f"fetched_at as observed_at, {key} as source_key, id as raw_record_id, {repo} as meta_repo "
                f"from ({src}) s")
    if resource in LN_NAMES:
        name = LN_NAMES[resource]

        def person(prefix, fields):
            return _nz(resource, *[f"p_{prefix}_{f}" for f in fields])
        subj = {
            "linear_issues": person("assignee", ["id", "email", "displayName", "name"])
            + person("creator", ["id", "email", "displayName", "name"]),
            "linear_comments": person("user", ["id", "email", "displayName", "name"])
            + person("externalUser", ["id", "email", "displayName", "name"]),
            "linear_projects": person("lead", ["id", "email", "displayName", "name"]),
            "linear_description_edits": _nz(resource, "p_descriptionUpdatedBy")
            + person("actor", ["id", "email", "displayName", "name"]),
        }[resource]
        subj = "coalesce(" + ", ".join(subj + ["'unknown'"]) + ")"
        return (f"select tenant_id, 'linear' as source, 'linear' as tool, 'event' as kind, '{name}' as name, "
                f"'user' as subject_type, {subj} as subject_id, coalesce(p_createdAt, fetched_at) as occurred_at, "
                f"fetched_at as observed_at, '{name}:' || p_id as source_key, id as raw_record_id "
                f"from ({src}) s where nullif(p_id, '') is not null")
    if resource == "copilot_usage":
        start = "date_trunc('day', coalesce(try_cast(nullif(p_day, '') as timestamp), fetched_at))"
        subj = "coalesce(nullif(p_user_login, ''), nullif(p_org, ''), 'unknown')"
        return (f"select tenant_id, 'github' as source, 'github_copilot' as tool, 'measurement' as kind, "
                f"'copilot.usage' as name, case when nullif(p_user_login, '') is not null then 'user' else 'org' end "
                f"as subject_type, {subj} as subject_id, {start} as occurred_at, {start} as period_start, "
                f"{start} + interval 1 day as period_end, fetched_at as observed_at, "
                f"{subj} || ':' || strftime({start}, '%Y-%m-%d') as source_key, id as raw_record_id, "
                f"cast(p_total_suggestions_count as varchar) as meta_total from ({src}) s")
    raise KeyError(resource)
