"""Envelope metadata: stored types, absent and null fields, commits."""

import json

import pytest
from pyspark.sql import functions as F

from tallyspark.sources import landing as A


@pytest.fixture(scope="module")
def envelopes(spark):
    rows = [
        ("r1", "github", "commits", {"sha": "abc", "org": "o", "repo": "r", "author": {"login": "ann"}, "created_at": "2024-01-09T00:00:00Z",
                                     "commit": {"author": {"date": "2024-01-02T03:04:05Z"}, "committer": {"date": "2024-01-03T00:00:00Z"}}}),
        ("r2", "github", "commits", {"sha": "def", "repo": "r", "commit": {"committer": {"date": "2024-01-03T00:00:00Z"}}}),
        ("r3", "github", "releases", {"id": 7, "org": "o", "repo": "r", "name": "1", "draft": False, "prerelease": True, "tag_name": "v1", "state": None,
                                      "user": {"login": "bob"}, "created_at": "2024-01-04T00:00:00Z"}),
        ("r4", "github", "reviews", {"id": 8, "node_id": "n8", "number": 3, "pull_request_number": 3, "draft": True, "state": "APPROVED",
                                     "submitted_at": "2024-01-05T00:00:00Z"}),
        ("r5", "linear", "issues", {"id": "i1", "identifier": "T-1", "priority": 2, "estimate": 0.5, "title": 'a "b"', "url": None, "createdAt": "2024-01-05T00:00:00Z"}),
        ("r6", "linear", "comments", {"id": "c1", "projectId": "p9", "issue": {"id": "i1"}, "createdAt": "2024-01-05T00:00:00Z"}),
        ("r7", "copilot", "copilot_usage", {"day": "2024-01-06", "user_login": "ann", "org": "o", "total": 4, "active": True, "by": [{"n": 1}], "none": None}),
    ]
    raw = spark.createDataFrame([("t", s, rt, i, json.dumps(p)) for i, s, rt, p in rows], f"tenant_id string, source string, resource_type string, id string, {A.P} string")
    raw = raw.withColumn("fetched_at", F.lit("2024-02-01").cast("timestamp"))
    out = A.env_github(raw).unionByName(A.env_linear(raw)).unionByName(A.env_copilot(raw))
    return {r.raw_record_id: r for r in out.collect()}


def test_metadata_keeps_stored_types(envelopes):
    meta = {k: json.loads(r.metadata) for k, r in envelopes.items()}
    assert meta["r3"] == {"stream": "releases", "repo": "o/r", "name": "1", "draft": False, "prerelease": True, "tag_name": "v1"}
    assert meta["r4"] == {"stream": "reviews", "number": 3, "pull_request_number": 3, "state": "APPROVED"}
    assert meta["r5"] == {"stream": "issues", "identifier": "T-1", "priority": 2, "estimate": 0.5, "title": 'a "b"'}
    assert meta["r6"] == {"stream": "comments", "projectId": "p9", "issue_id": "i1"}
    assert meta["r7"] == {"org": "o", "total": 4, "active": True, "by": [{"n": 1}], "none": None}


def test_commits_take_author_then_committer_date(envelopes):
    a, b = envelopes["r1"], envelopes["r2"]
    assert (str(a.occurred_at), a.subject_id, json.loads(a.metadata)) == ("2024-01-02 03:04:05", "ann", {"stream": "commits", "repo": "o/r", "sha": "abc"})
    assert str(b.occurred_at) == "2024-01-03 00:00:00" and b.subject_id == "unknown" and b.source_key.endswith(":def")
    assert json.loads(b.metadata)["repo"] == "r"
