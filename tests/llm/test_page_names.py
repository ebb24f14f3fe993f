"""Main text where class, id and role names mislead, and pairing of pages by what blocks() finds."""
import pytest

from pathscreen.llm import page_diff

ARTICLE = "<article><h1>Title</h1><p>Text</p></article>"
CASES = [
    (f"<div class='layout has-sidebar'>{ARTICLE}</div>", ["Title", "Text"]), (f"<div class='no-sidebar'>{ARTICLE}</div>", ["Title", "Text"]), (f"<section id='related-work'>{ARTICLE}</section>", ["Title", "Text"]),
    (f"<div class='sidebar'>{ARTICLE}</div>", ["Title", "Text"]), (f"<div data-role='menu' data-id='ad'>{ARTICLE}</div>", ["Title", "Text"]),
    ("<article><div class='article-header'><h1>Title</h1></div><p>Text</p></article>", ["Title", "Text"]), ("<article><div class='header'><h1>Title</h1></div><p>Text</p></article>", ["Title", "Text"]),
    (f"<div class='sidebar'><article>teaser</article></div><main>{ARTICLE}</main>", ["Title", "Text"]), (f"{ARTICLE}<div class='comments'><article>me too</article></div>", ["Title", "Text"]),
    ("<article><p>Text</p><div class='comments'><article>me too</article></div></article>", ["Text"]), (f"<div class='comments'>{ARTICLE}</div>", ["Title", "Text"]),
    (f"<div class='cookie-banner'>ok?</div><div class='site-footer'>f</div><div class='ad-slot-1'>buy</div>{ARTICLE}", ["Title", "Text"]),
    (f"<main class='sidebar-left'>{ARTICLE}<div role='complementary'>c</div></main>", ["Title", "Text"]),
]
NOT_MARKED = [
    ("<p>Prose</p><div class='comments'><article>me too</article></div>", ["Prose"]), (f"<p>Prose</p><nav>{ARTICLE}</nav>", ["Prose"]), ("<p>Prose</p><div role='navigation'><article>x</article></div>", ["Prose"]),
    ("<div class='cookie-banner'>ok?</div><div class='site-footer'>f</div><div class='ad-slot-1'>buy</div><p>Prose</p>", ["Prose"]), ("<div class='has-menu'><p>Prose</p></div>", ["Prose"]), ("<h1 class='header'>Head</h1>", ["Head"]),
    ("<p role='main-note'>Prose</p>", ["Prose"]),
]


@pytest.mark.parametrize("page,want", CASES)
def test_article(page, want):
    main, _, marked = page_diff.blocks(page)
    assert marked and main == want


@pytest.mark.parametrize("page,want", NOT_MARKED)
def test_no_article(page, want):
    main, other, marked = page_diff.blocks(page)
    assert not marked and not main and other == want


def test_pages_pair_by_what_is_marked(spark):
    extra = ["<script>var a = '<article>';</script>", "<!-- <main> -->", "<aside><article>more</article></aside>", "<div class='ad'><article>buy</article></div>"]
    plain = "<body>%s<p>Shared top</p><p>Own %d</p><p>Shared end</p></body>"
    pages = [(i, f"http://h{i}.x/a/{k}", plain % (x, 10 * i + k)) for i, x in enumerate(extra) for k in (1, 2)]
    out = page_diff.main_texts(spark.createDataFrame(pages, "page_id long, url string, html string")).collect()
    assert {(r.page_id, r.url[-1], r.text, r.n_shared) for r in out} == {(i, str(k), f"Own {10 * i + k}", 2) for i in range(len(extra)) for k in (1, 2)}


def test_pages_that_mark_an_article_are_paired_too(spark):
    page = "<nav>Home</nav><p>Teaser %d</p><article><h1>Title %d</h1><p>Same words</p></article><footer>All rights</footer>"
    pages = [(k, f"http://h.x/a/{k}", page % (k, k)) for k in (1, 2)] + [(3, "http://other.x/a/1", page % (1, 1))]
    out = page_diff.main_texts(spark.createDataFrame(pages, "page_id long, url string, html string")).collect()
    assert {(r.page_id, r.text) for r in out} == {(i, f"Title {k}\n\nSame words") for i, k in ((1, 1), (2, 2), (3, 1))}
    assert {(r.page_id, r.n_shared, r.n_repeated, r.n_restored) for r in out} == {(1, 0, 3, 1), (2, 0, 3, 1), (3, 0, 0, 0)}
