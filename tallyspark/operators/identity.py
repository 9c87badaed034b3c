"""Identity resolution as set-based joins.

The reference walks identities one by one; the order decides who wins a
contested user. Here every rule is a join or a window with a fixed order —
(link method, external id) — so a run is deterministic and needs no loop.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallyspark.functions.jsonx import jstr
from tallyspark.operators.snapshot import latest_landed
from tallyspark.session import written

METHOD_RANK = {"oauth_id": 0, "email": 1, "provisioned": 2}
IDENTITY_COLS = ["tenant_id", "external_user_id", "login", "email", "name", "org_role", "user_id",
                 "link_method", "status"]


def latest_payload_by_login(raw: DataFrame, resource_type: str) -> DataFrame:
    """Newest payload per (tenant, login) of one resource (ties: larger id)."""
    rows = raw.where(F.col("resource_type") == resource_type)
    keyed = rows.select("tenant_id", jstr(F.col("payload"), "login").alias("login"), "fetched_at", "id").withColumn("_ok", F.col("login").isNotNull())
    return latest_landed(rows, keyed, ["tenant_id", "login"], "_ok").select("tenant_id", "login", "payload")


def build_roster(members: DataFrame, profiles: DataFrame, admins: DataFrame) -> DataFrame:
    """Members (latest payloads) left-join profiles; members without id are dropped.

    ``admins`` = (tenant_id, login) of org admins; empty email/name become NULL.
    """
    m = members.select("tenant_id", "login", jstr(F.col("payload"), "id").alias("external_user_id")) \
        .where(F.col("external_user_id").isNotNull())
    p = profiles.select("tenant_id", "login",
                        F.nullif(jstr(F.col("payload"), "email"), F.lit("")).alias("email"),
                        F.nullif(jstr(F.col("payload"), "name"), F.lit("")).alias("name"))
    a = admins.select("tenant_id", "login", F.lit(True).alias("_admin")).distinct()
    j = m.join(p, ["tenant_id", "login"], "left").join(a, ["tenant_id", "login"], "left")
    return j.select("tenant_id", "external_user_id", "login", "email", "name",
                    F.when(F.col("_admin"), "admin").otherwise("member").alias("org_role"))


def upsert_identity(existing: DataFrame, roster: DataFrame) -> DataFrame:
    """Upsert by (tenant, external id); a NULL email/name keeps the old value."""
    o = existing.select(*[F.col(c).alias("o_" + c) for c in IDENTITY_COLS])
    n = roster.select(*[F.col(c).alias("n_" + c) for c in
                        ["tenant_id", "external_user_id", "login", "email", "name", "org_role"]])
    j = o.join(n, (o.o_tenant_id == n.n_tenant_id) & (o.o_external_user_id == n.n_external_user_id), "full_outer")
    new = F.col("n_external_user_id").isNotNull()
    return j.select(
        F.coalesce("n_tenant_id", "o_tenant_id").alias("tenant_id"),
        F.coalesce("n_external_user_id", "o_external_user_id").alias("external_user_id"),
        F.when(new, F.col("n_login")).otherwise(F.col("o_login")).alias("login"),
        F.coalesce("n_email", "o_email").alias("email"),
        F.coalesce("n_name", "o_name").alias("name"),
        F.when(new, F.col("n_org_role")).otherwise(F.col("o_org_role")).alias("org_role"),
        F.col("o_user_id").alias("user_id"),
        F.col("o_link_method").alias("link_method"),
        F.coalesce("o_status", F.lit("pending_email")).alias("status"),
    )


def _one_per_user(cands: DataFrame, identities: DataFrame) -> DataFrame:
    """A user holds one identity per tenant. Users already linked in the
    tenant claim nothing; among new claims the first by (method, external id) wins.

    The winner is a ``min_by`` aggregate (partial, map-side), so a user claimed
    by a huge number of identities (a shared no-reply address) is not sorted
    in one task."""
    linked = identities.where(F.col("user_id").isNotNull()).select("tenant_id", F.col("user_id").alias("_cand"))
    c = cands.join(linked.distinct(), ["tenant_id", "_cand"], "left_anti")
    rank = F.create_map(*[x for k, v in METHOD_RANK.items() for x in (F.lit(k), F.lit(v))])[F.col("_method")]
    best = F.min_by(F.struct("external_user_id", "_method"), F.struct(rank, F.col("external_user_id")))
    return (c.groupBy("tenant_id", "_cand").agg(best.alias("_w"))
            .select("tenant_id", "_cand", F.col("_w.external_user_id").alias("external_user_id"),
                    F.col("_w._method").alias("_method")))


def link_identity(identities: DataFrame, users: DataFrame, oauth: DataFrame) -> DataFrame:
    """J4 (+J5, J6 ids): link unlinked identities — oauth id match, else
    lower(email) match, else provision a user when there is an email, else
    pending. users: (user_id, email); oauth: (account_id, user_id)."""
    un = identities.where(F.col("user_id").isNull())
    by_oauth = oauth.groupBy(F.col("account_id").alias("_acc")).agg(F.min("user_id").alias("_u_oauth"))
    by_email = (users.where(F.col("email").isNotNull())
                .groupBy(F.lower("email").alias("_em")).agg(F.min("user_id").alias("_u_email")))
    c = (un.join(by_oauth, un.external_user_id == by_oauth._acc, "left")
         .join(by_email, F.lower(un.email) == by_email._em, "left"))
    method = (F.when(F.col("_u_oauth").isNotNull(), "oauth_id")
              .when(F.col("email").isNotNull() & F.col("_u_email").isNotNull(), "email")
              .when(F.col("email").isNotNull(), "provisioned"))
    cand = F.coalesce(F.col("_u_oauth"), F.when(F.col("email").isNotNull(), F.col("_u_email")),
                      F.when(F.col("email").isNotNull(), F.concat(F.lit("prov:"), F.lower("email"))))
    c = c.select("tenant_id", "external_user_id", method.alias("_method"), cand.alias("_cand"))
    winners = _one_per_user(c.where(F.col("_cand").isNotNull()), identities)
    j = identities.join(winners, ["tenant_id", "external_user_id"], "left")
    won = F.col("_cand").isNotNull()
    no_match_no_email = F.col("user_id").isNull() & F.col("email").isNull()
    return j.select(
        "tenant_id", "external_user_id", "login", "email", "name", "org_role",
        F.when(won, F.col("_cand")).otherwise(F.col("user_id")).alias("user_id"),
        F.when(won, F.col("_method")).otherwise(F.col("link_method")).alias("link_method"),
        F.when(won & (F.col("_method") == "provisioned"), "provisioned")
         .when(won, "linked")
         .when(no_match_no_email, "pending_email")
         .otherwise(F.col("status")).alias("status"))


def provision_users(linked: DataFrame) -> DataFrame:
    """One new user per lower-cased email of identities linked by provisioning."""
    p = linked.where(F.col("link_method") == "provisioned")
    return (p.groupBy(F.lower("email").alias("email"))
            .agg(F.min("user_id").alias("user_id"), F.min("name").alias("name"))
            .select("user_id", "email", "name"))


def _role(org_role):
    return F.when(org_role == "admin", "admin").otherwise("individual")


def ensure_membership(linked: DataFrame, memberships: DataFrame, before: DataFrame) -> DataFrame:
    """Memberships to add for the users that this run linked (role from the org role).

    Identities that ``before`` had linked already add nothing, so a member removed since stays removed."""
    old = before.where(F.col("user_id").isNotNull()).select("tenant_id", "external_user_id")
    fresh = linked.where(F.col("user_id").isNotNull()).join(old, ["tenant_id", "external_user_id"], "left_anti")
    ids = fresh.select("tenant_id", "user_id", _role(F.col("org_role")).alias("role"))
    new = ids.join(memberships.select("tenant_id", "user_id"), ["tenant_id", "user_id"], "left_anti")
    return new.groupBy("tenant_id", "user_id").agg(F.min("role").alias("role"))


def reconcile_roles(linked: DataFrame, memberships: DataFrame) -> DataFrame:
    """Admin <-> individual follow the org role; ``manager`` stays; the last
    admin of a tenant is never demoted (demotions in external-id order while
    more than one admin would remain)."""
    ids = (linked.where(F.col("user_id").isNotNull()).groupBy("tenant_id", "user_id")
           .agg(F.min_by("org_role", "external_user_id").alias("org_role"),
                F.min("external_user_id").alias("external_user_id")))
    m = memberships.join(ids, ["tenant_id", "user_id"], "left")
    promote = (F.col("org_role") == "admin") & (F.col("role") != "admin")
    demote_cand = F.coalesce((F.col("org_role") == "member") & (F.col("role") == "admin"), F.lit(False))
    m = m.withColumn("_after", F.when(promote, "admin").otherwise(F.col("role"))) \
         .withColumn("_dc", demote_cand)
    # the rule keeps somebody only where every admin left is up for demotion, and then the last in order: counts and
    # one name per tenant, by partial aggregates
    tenant = m.groupBy("tenant_id").agg(
        F.count_if(F.col("_after") == "admin").alias("_admins"), F.count_if(F.col("_dc")).alias("_cands"),
        F.max(F.when(F.col("_dc"), F.struct("external_user_id", "user_id"))).alias("_last"))
    m = m.join(tenant, "tenant_id")
    last = (F.col("_admins") == F.col("_cands")) & (F.struct("external_user_id", "user_id") == F.col("_last"))
    return m.select("tenant_id", "user_id", F.when(F.col("_dc") & ~last, "individual").otherwise(F.col("_after")).alias("role"))


def claim_pending(identities: DataFrame, signups: DataFrame) -> DataFrame:
    """New sign-ups claim pending identities across tenants by oauth id or
    lower(email), one identity per user and tenant.
    signups: (user_id, oauth_id, email)."""
    pend = identities.where(F.col("user_id").isNull())
    by_oauth = pend.join(signups.where(F.col("oauth_id").isNotNull())
                         .select(F.col("oauth_id").alias("external_user_id"), F.col("user_id").alias("_cand")),
                         "external_user_id").withColumn("_method", F.lit("oauth_id"))
    by_mail = pend.join(signups.where(F.col("email").isNotNull())
                        .select(F.lower("email").alias("_em"), F.col("user_id").alias("_cand")),
                        F.lower(pend.email) == F.col("_em")).drop("_em").withColumn("_method", F.lit("email"))
    cands = by_oauth.unionByName(by_mail).select("tenant_id", "external_user_id", "_cand", "_method")
    # users that hold an identity of the tenant claim nothing, so they go before an identity chooses
    held = identities.where(F.col("user_id").isNotNull()).select("tenant_id", F.col("user_id").alias("_cand"))
    cands = cands.join(held.distinct(), ["tenant_id", "_cand"], "left_anti")
    # an identity claimed both ways keeps its best method (then the smallest user id)
    best = F.min_by(F.struct("_cand", "_method"),
                    F.struct(F.when(F.col("_method") == "oauth_id", 0).otherwise(1), F.col("_cand")))
    cands = (cands.groupBy("tenant_id", "external_user_id").agg(best.alias("_b"))
             .select("tenant_id", "external_user_id", F.col("_b._cand").alias("_cand"),
                     F.col("_b._method").alias("_method")))
    winners = _one_per_user(cands, identities)
    j = identities.join(winners, ["tenant_id", "external_user_id"], "left")
    won = F.col("_cand").isNotNull()
    return j.select("tenant_id", "external_user_id", "login", "email", "name", "org_role",
                    F.when(won, F.col("_cand")).otherwise(F.col("user_id")).alias("user_id"),
                    F.when(won, F.col("_method")).otherwise(F.col("link_method")).alias("link_method"),
                    F.when(won, "linked").otherwise(F.col("status")).alias("status"))


def member_logins(raw: DataFrame, tenant=None) -> DataFrame:
    """Distinct logins landed as organization members (per tenant)."""
    df = raw if tenant is None else raw.where(F.col("tenant_id") == tenant)
    login = jstr(F.col("payload"), "login")
    return (df.where((F.col("resource_type") == "organization_members") & login.isNotNull())
            .select("tenant_id", login.alias("login")).distinct())


def sync_and_link(raw: DataFrame, admins: DataFrame, existing: DataFrame, users: DataFrame, oauth: DataFrame,
                  memberships: DataFrame, checkpoint: bool = True) -> dict[str, DataFrame]:
    """J1-J8 as one pipeline for all tenants.

    The linked identities feed three later steps; they are written to the
    shared folder so a lost executor recomputes from there, not from the raw
    landing, and the plans below stay short."""
    members = latest_payload_by_login(raw, "organization_members")
    profiles = latest_payload_by_login(raw, "user_profiles")
    identities = upsert_identity(existing, build_roster(members, profiles, admins))
    if checkpoint:
        identities = written(identities, "identities")   # read three times by the linking step
    linked = link_identity(identities, users, oauth)
    if checkpoint:
        linked = written(linked, "linked")
    new_members = ensure_membership(linked, memberships, identities)
    return {
        "identities": linked,
        "new_users": provision_users(linked),
        "new_memberships": new_members,
        "roles": reconcile_roles(linked, memberships.unionByName(new_members)),
    }
