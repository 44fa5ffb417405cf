"""A bean for every metric rule, against the rules read one by one in Python."""

from __future__ import annotations

import re

import pytest

from rowtide.operators import metric_names as mn

FILLS = {"(.+)": "Some-Name", r"(\w+)": "used", "([^,]+)": "first one", "([^>]+)": "pool 1", "([^:]+)": "rate-avg", "([^,>]+)": "kind",
         "(request-[^:]+|response-[^:]+)": "request-rate"}


def bean_of(pattern):
    text = pattern
    for group, value in sorted(FILLS.items(), key=lambda g: -len(g[0])):
        text = text.replace(group, value)
    text = re.sub(r"\((\w+)\|[^)]*\)", r"\1", text)  # the first of the named attributes
    return re.sub(r"\\(.)", r"\1", text) + ": 1"


def plain(bean, rules):
    for r in rules:
        found = re.search(r.pattern, bean)
        if found:
            fill = lambda t: re.sub(r"\$(\d)", lambda m: found[int(m[1])], t)
            return r, fill(r.name), {k: fill(v) for k, v in r.labels.items()}
    return None


@pytest.mark.parametrize("rules", [mn.connect_rules, mn.broker_rules, mn.registry_rules])
def test_a_bean_for_every_rule(spark, rules):
    rules = rules()
    beans = [bean_of(r.pattern) for r in rules]
    got = {r.bean: r for r in mn.normalise_metrics(spark.createDataFrame([(b,) for b in beans], "bean string"), rules).collect()}
    own = {f"debezium_metrics_{a}": ("debezium_metrics_" + n, k) for a, n, k in mn.ATTRIBUTES}
    hit = set()
    for bean in beans:
        rule, name, labels = plain(bean, rules)
        hit.add(rule.pattern)
        want, kind = own[name] if rule.table and name in own else (re.sub("[^a-z0-9_:]", "_", name.lower()), rule.type)
        assert (got[bean].metric, got[bean].type, got[bean].labels) == (want, kind, labels), bean
    assert len(hit) >= len(rules) - 2  # a rule can be hidden by an earlier, wider one
