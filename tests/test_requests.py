"""A1 + F4 + B8 + E1 + B19: run inputs from JSON, url first then startUrls, trim, first-seen dedupe."""

import json
import os
import tempfile

from pagemill.operators.requests import clean_requests, first_seen, read_requests, run_options, union_inputs, validate_runs


def test_inputs_to_unique_requests(spark):
    d = tempfile.mkdtemp(prefix="pm-in-", dir="/tmp")
    runs = [
        {"run_id": 1, "url": " http://a.com/ ", "startUrls": ["http://b.com/", "http://a.com/", "", "http://a.com"],
         "includeLinks": False},
        {"run_id": 2, "startUrls": ["　http://c.com/x﻿", "http://c.com/x"], "renderJs": True, "eventLimit": 3},
        {"run_id": 3, "startUrls": ["  ", ""]},
    ]
    with open(os.path.join(d, "in.json"), "w") as f:
        f.write("\n".join(json.dumps(r) for r in runs))
    inputs = read_requests(spark, d)
    unique = first_seen(clean_requests(union_inputs(inputs)))
    got = sorted((r.run_id, r.ord, r.url) for r in unique.collect())
    # url comes first; the raw-string dedupe keeps "http://a.com" and "http://a.com/" apart (Q1)
    assert got == [(1, 0, "http://a.com/"), (1, 1, "http://b.com/"), (1, 4, "http://a.com"), (2, 0, "http://c.com/x")]
    opts = {r.run_id: r for r in run_options(inputs).collect()}
    assert opts[1].include_links is False and opts[2].render_js is True and opts[3].include_links is True
    v = {r.run_id: r.error for r in validate_runs(inputs.select("run_id"), unique).collect()}
    assert v[3].startswith("No URLs given.") and v[1] is None
