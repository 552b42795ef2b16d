"""The report gate on reports with one fault each."""

from __future__ import annotations

import pytest

from loomgraph.operators import report_gate as G

PROSE = "This paragraph is long enough to be read as prose by the gate, as it has over eighty characters in it, number"
GOOD = "# Report\n\n" + "\n\n".join(f"## {s}\n\n{PROSE} {i}.\n\n| a | b |\n|---|---|\n| 1 | 2 |\n- item {i}" for i, s in enumerate(G.SECTIONS)) + "\n"

FAULTS = {
    "good": (GOOD, set()),
    "missing": (GOOD.replace("## 구조 분석", "## 구조"), {("missing section", "구조 분석")}),
    "empty": (GOOD.replace("## 부록", "## Nothing here\n\n*분석 근거: x\n## 부록"), {("empty section", "## Nothing here")}),
    "far from empty": (GOOD.replace("## 부록", "## Nothing near\n\n\n\n## 부록"), set()),
    "table": (GOOD + "| a | b |\n|---|---|\n| 1 | 2 | 3 |\n| 1 |\ntext\n| 1 |\n", {("broken table", f"line {GOOD.count(chr(10)) + 3}: 2 and 3 columns")}),
    "last table": (GOOD + "| a | b |\n| 1 |", {("broken table", f"line {GOOD.count(chr(10)) + 2}: 2 and 1 columns")}),
    "artifact": (GOOD + "value: None, and undefined\n", {("artifact", r"None\b"), ("artifact", "undefined")}),
    "short": ("", {("too short", "0")} | {("missing section", s) for s in G.SECTIONS}),
    "repeated": (GOOD.replace("- item 3", "- the very same sentence as below").replace("- item 5", "  - the very same sentence as below"), {("repeated sentence", "- the very same sentence as below: ## 시스템 다이내믹스 and ## 시나리오 분석")}),
    "unread": ("\n".join(f"## {s}\n- line {i}\n{'short words ' * 5}{i}" for i, s in enumerate(G.SECTIONS)), {("uninterpreted", "9 of 6")}),
    "marked": ("\n".join(f"## {s}\n- line {i}\n{'short words ' * 5}{i} 종합 해석" for i, s in enumerate(G.SECTIONS)), set()),
    "no data": (GOOD.replace("| 1 | 2 |\n- item 7", "| N/A | 2 |\n- 없음\n- 없습니다\n- N/A\n- item 7"), {("without data", "## 리스크 매트릭스")}),
}


@pytest.fixture(scope="module")
def found(spark):
    rows = G.issues(spark.createDataFrame([(k, t) for k, (t, _) in FAULTS.items()] + [("null", None)], "report string, text string")).collect()
    out = {}
    for r in rows:
        out.setdefault(r["report"], set()).add((r["check"], r["detail"]))
    return out


@pytest.mark.parametrize("name", sorted(FAULTS))
def test_one_fault_each(found, name):
    assert found.get(name, set()) == FAULTS[name][1]


def test_a_null_report_is_an_empty_one(found):
    assert found["null"] == found["short"]
