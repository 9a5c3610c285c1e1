"""The change plan against a plain version, and a compile of documents from text to pages."""

import html
import re

from tesserine.operators import compiling, writing

DOCS = [(1, "Src | <one>", "W", 3), (2, "Empty", "W", 1)]
ENTITIES = [(1, "alpha", 0, "Alpha", "person", "Sum A"), (1, "beta-b", 1, "Beta \"B\"", "concept", "Sum B"), (1, "gamma", 2, "Gamma", "event", "Sum C")]
CLAIMS = [(1, 0, "Alpha", "A is one", 0.995, "the third page says"), (1, 1, "Alpha", "A is two", 0.5, ""), (1, 2, "Gamma", "G", 0.125, "nothing like it zzz"), (1, 3, "Nobody", "N", 1.0, "")]
RELATIONS = [(1, 0, "Alpha", "Beta \"B\"", "knows|of"), (1, 1, "Alpha", "Alpha", "is"), (1, 2, "Else", "Alpha", "saw")]
BLOCKS = [(1, 0, 1, "  "), (1, 1, 2, "second page says"), (1, 2, 3, "THE THIRD page says so")]


def slug(t):
    return re.sub("[^a-z0-9]+", "-", t.lower()).strip("-") or "item"


def node(s, t):
    return f'{s}["{html.escape(t)}"]'


def plain():
    out = []
    for d, source, space, pages in DOCS:
        blocks = sorted(b for b in BLOCKS if b[0] == d)
        latest = next((b[2] for b in blocks if b[3].strip()), 1)

        def page(quote, blocks=blocks, latest=latest):
            best, most = latest, 0
            for b in blocks:
                n = sum(w in b[3].lower() for w in quote.lower().split()[:10])
                if quote and n > most:
                    best, most = b[2], n
            return best

        mine = [e for e in ENTITIES if e[0] == d]
        for k, (_, s, _, title, kind, summary) in enumerate(mine):
            cited = [(c, page(c[5])) for c in CLAIMS if c[0] == d and c[2] == title]
            lines = [f"- {c[3]} (confidence: {c[4]:.0%})[^{p}]" for c, p in cited] or [f"{summary}[^{latest}]"]
            arrows = []
            for r in RELATIONS:
                for end, other in ((r[2], r[3]), (r[3], r[2])):
                    if r[0] == d and end == title:
                        arrows.append(f"    {node(s, title)} -->|{r[4].replace('|', '/')}| {node(slug(other), other)}")
            arrows = arrows or [f"    {node('source-' + slug(source), source)} --> {node(s, title)}", f"    {node(s, title)} --> {node('compiled-wiki', 'Compiled Wiki')}"]
            notes = [f"[^{p}]: {source}, p.{p}" for p in sorted({p for _, p in cited} or {latest})]
            text = "\n".join([summary, "", "## Snapshot", "", "| Attribute | Value |", "| --- | --- |", f"| Type | {kind} |", f"| Source | {source} |", f"| Workspace | {space} |", "", "```mermaid", "graph TD", *arrows, "```", "", "## Evidence", "", *lines, "", *notes, ""])
            out.append((d, k + 1, "create_doc", f"/wiki/{'concepts' if kind == 'concept' else 'entities'}/{s}.md", title, text, f"Compile {kind} from source {source}"))
        counts = [sum(x[0] == d for x in rows) for rows in (ENTITIES, CLAIMS, RELATIONS)]
        log = f"## [2024-05-06] ingest | {source}\n- Parsed {pages} page(s)\n- Extracted {counts[0]} entities, {counts[1]} claims, {counts[2]} relations\n- Updated overview and compiled wiki pages\n"
        out.append((d, len(mine) + 1, "append_content", "/wiki/log.md", "Log", log, f"Append ingest log for {source}"))
    return out


def test_change_plan(spark):
    f = spark.createDataFrame
    plan = compiling.change_plan(
        f(DOCS, "doc_id long, title string, workspace string, pages int"), f(ENTITIES, "doc_id long, slug string, nth int, title string, entity_type string, summary string"), f(CLAIMS, "doc_id long, nth int, entity_title string, text string, confidence double, quote string"),
        f(RELATIONS, "doc_id long, nth int, source_title string, target_title string, relation_type string"), f(BLOCKS, "doc_id long, chunk_idx int, page_no int, text string"), "2024-05-06",
    )
    assert sorted(map(tuple, plan.collect())) == sorted(plain())


def test_documents_become_pages_and_a_log(spark):
    docs = spark.createDataFrame([(1, "First", "W", "# Alpha Works\n\nAlpha Works knows Beta. Beta knows Gamma Ray."), (2, "Second", "W", "Beta met Alpha Works.\n\nGamma Ray."), (3, "Third", "W", "nothing here")], "doc_id long, title string, workspace string, content_md string")
    made = compiling.compile_documents(docs, "2024-05-06", least=0.0)
    assert {r["slug"] for r in made["entities"].collect()} == {"alpha-works", "beta", "gamma-ray"}
    actions = made["plan"].selectExpr("doc_id * 1000 + nth as seq", "path", "title", "op", "content", "reason")
    none = docs.limit(0).selectExpr("doc_id", "workspace as workspace_id", "'' as path", "title", "'' as kind", "'' as policy", "false as archived", "content_md")
    heads, revisions, _ = writing.apply_actions(none, actions)
    pages = {r["path"]: r["content_md"] for r in heads.collect()}
    assert set(pages) == {"/wiki/concepts/alpha-works.md", "/wiki/concepts/beta.md", "/wiki/concepts/gamma-ray.md", "/wiki/log.md"}
    assert pages["/wiki/log.md"].count("] ingest | ") == 3 and "[^1]: Second, p.1" in pages["/wiki/concepts/beta.md"]
    assert revisions.count() == actions.count()
