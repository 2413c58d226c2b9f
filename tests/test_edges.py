"""Edge extraction by its four rules, and names resolved by containment."""

from quarry.operators import graph


def test_containment(spark):
    refs = spark.createDataFrame([("quest",), ("The Skill Tree of all",), ("none",), ("",), ("PK_Shop",)], "ref string")
    nodes = spark.createDataFrame([("PK_Quest System",), ("PK_Big Quest",), ("skill tree",), ("Shop",), ("Shop Window",)], "node string")
    got = {r.ref: r.node for r in graph.resolve_names(refs, nodes).collect()}
    assert got == {"quest": "PK_Big Quest", "The Skill Tree of all": "skill tree", "PK_Shop": "Shop"}
    own = spark.createDataFrame([("PK_Big Quest", "quest"), ("Shop", "PK_Shop"), ("Shop", "win")], "at string, ref string")
    got = {(r.source, r.ref, r.node) for r in graph.resolve_names(own, nodes, source="at").collect()}
    assert got == {("PK_Big Quest", "quest", "PK_Quest System"), ("Shop", "win", "Shop Window")}


def test_four_rules(spark):
    rows = [
        ("PK_Quest", "see 'PK_Skill']). and PK_Quest, PK_\n=Shop!B12 + Sheet1!A1 + Bag!C3 + Mai!D4\n## About Guild hall\n#### Pet\n", ["Sheet1"], ["소환 시스템", " x "]),
        ("PK_Skill", "nothing", [], None), ("PK_Shop", None, None, []), ("Bag", "", [], []), ("PK_Mail", "#  Quest again", [], []), ("PK_Guild", "", [], []), ("PK_Pet", "", [], []), ("PK_소환", "", [], []),
    ]
    docs = spark.createDataFrame(rows, "system string, text string, sheets array<string>, declared array<string>")
    got = {(r.source, r.ref, r.rule) for r in graph.extracted_edges(docs).collect()}
    quest = {("PK_Skill", "prefix"), ("PK_Shop", "cell"), ("Bag", "cell"), ("PK_Mail", "cell"), ("PK_Guild", "heading"), ("PK_소환", "declared")}
    assert got == {("PK_Quest", *x) for x in quest} | {("PK_Mail", "PK_Quest", "heading")}
    pairs = {(r.src, r.dst) for r in graph.related_systems(docs).collect()}
    ends = {x for x, _ in quest}
    assert pairs == {("PK_Quest", x) for x in ends} | {(x, "PK_Quest") for x in ends}
