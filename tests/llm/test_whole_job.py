"""Cases in which an operator once did less than the whole job."""

import hashlib

import pytest

from slideloom.llm import html_text, license_scan, pii, queries


def words_from(prefix, n):
    return " ".join(f"{prefix}{i}" for i in range(n)) + "."


def test_passage_after_an_unfinished_sentence_is_removed(spark, tmp_path):
    # 53 words: pasted mid-line the first sentence merges with the words before it, and 22 or 27 words of whole sentences are left
    two = [words_from("a", 31), words_from("b", 10), words_from("c", 12)]
    one = [words_from("d", 26), words_from("e", 27)]
    texts = [f"Own start. {' '.join(two)}", f"Words without an end {' '.join(two)} Own end.", f"Another start. {' '.join(one)}", f"and words like these {' '.join(one)} Last words.", "Short one. Short two.", "Short one. Short two."]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: r for r in queries.op1_substring_dedup(spark, str(tmp_path)).collect()}
    assert [got[i].n_removed_words for i in range(6)] == [0, 22, 0, 27, 0, 0]
    assert "b3" not in got[1].text and "c3" not in got[1].text and "Own end." in got[1].text and "e3" not in got[3].text


@pytest.mark.parametrize("copies", [1, 2, 3, 4])
def test_adjacent_copies_of_a_notice_are_all_found(spark, copies):
    # a word set in the middle of the last copy: it is aligned but not equal; one notice further on stands alone
    names = [n for n in license_scan.TEMPLATES if n != "all-rights-reserved"]
    texts, want = [], []
    for name in names:
        notice = license_scan.TEMPLATES[name]
        at = notice.index(" ", len(notice) // 2)
        parts = [notice] * copies + [f"{notice[:at]} so{notice[at:]}", "word " * 300 + notice]
        texts.append("Our license. " + " ".join(parts) + " Under a license.")
        want.append([name] * (copies + 2))
    got = {r.doc_id: r.licenses for r in license_scan.scan_licenses(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    for i, name in enumerate(names):
        assert [x.license for x in got[i]] == want[i], name
        assert all(x.coverage == 1 and a.past <= x.first for a, x in zip(got[i], got[i][1:], strict=False)), name
        assert texts[i][got[i][0].first : got[i][0].past] == license_scan.TEMPLATES[name].rstrip("."), name


LONG = "Plain words of a long paragraph that says a good deal about its subject. " * 4
BODY = f"<p>{LONG}</p>" * 5
LINKS = "<ul>" + "<li><a href=x>Elsewhere on this site</a></li>" * 6 + "</ul>"


@pytest.mark.parametrize(
    ("page", "stays", "goes"),
    [
        (f"<article><h1>A headline</h1><div>{BODY}</div></article>", ["A headline"], []),
        (f"<div><h1><a href=x>A headline</a></h1><blockquote>Said so.</blockquote><div><div>{BODY}</div></div></div>{LINKS}", ["A headline", "Said so."], ["Elsewhere"]),
        (
            f"<nav>Menu</nav><main><header><h1>A headline</h1></header><p>Short lead.</p><div>{BODY}</div><h2>Subhead</h2><blockquote>Said so.</blockquote><div>{BODY}</div><p>Short end.</p>{LINKS}</main>",
            ["A headline", "Short lead.", "Subhead", "Said so.", "Short end."], ["Menu", "Elsewhere"],
        ),
        (f"{LINKS}<div>{BODY}</div><h2>Subhead</h2>Bare text.<blockquote>Said so.</blockquote>{LINKS}<ul><li>One thing</ul><div>{BODY}</div>{LINKS}", ["Subhead", "Bare text.", "Said so.", "One thing"], ["Elsewhere"]),
    ],
)
def test_parts_beside_the_main_block_stay(page, stays, goes):
    text = html_text.main_text(f"<html><body>{page}</body></html>")
    blocks = text.split("\n\n")
    at = [blocks.index(x) for x in stays]
    assert at == sorted(at) and text.count(LONG.strip()) == page.count(LONG)
    assert not any(x in text for x in goes)


@pytest.mark.parametrize("around", [
    "<div class='content-sidebar-wrap'>", "<div class=has-sidebar>", "<div class=no-comments>", "<div class=page-with-header>", "<div id=social-policy>",
    "<form action=x>", "<div class=sidebar>", "<section role=search>", "<div class='wrap left-sidebar'>",
])
@pytest.mark.parametrize("inner", ["<article><h1>A headline</h1>{}</article>", "<div><h1>A headline</h1>{}</div>"])
def test_wrappers_of_a_page_are_not_dropped(around, inner):
    end = f"</{around[1:].split()[0]}>"
    junk = "<nav>Menu</nav><div class=left-sidebar>Side</div><div class=comment-list>Said</div><form>Ask</form><div class='x share'>Send</div>"
    page = f"<body>{around}{junk}{inner.format(BODY)}{end}<div class=sidebar>Side</div></body>"
    assert html_text.main_text(page).split("\n\n") == ["A headline", *[LONG.strip()] * 5]


def test_names_that_are_no_marks_keep_smaller_parts():
    for name in ("content-sidebar-wrap", "has-sidebar", "no-comments", "page-with-header", "social-policy"):
        assert "Short lead." in html_text.main_text(f"<article><div class={name}><p>Short lead.</p></div>{BODY}</article>"), name


def test_long_secrets_are_redacted_to_their_end(spark):
    def token(seed, n):
        return "".join(hashlib.sha256(f"{seed}:{i}".encode()).hexdigest() for i in range(n // 64 + 1))[:n]

    plain = [f"The password: {token(i, 40)} opens it." for i in range(40)]
    card = "ab" + token("x", 300) + "z4111111111111111z" + token("y", 300)
    long = [f"The password: {token('a', 2000)} opens it.", f"The secret = '{token('b', 257)}' opens it.", f"The password: {card} opens it."]
    docs = spark.createDataFrame(list(enumerate([*plain, *long])), "doc_id long, text string")
    got = {r.doc_id: r.text for r in pii.redact_pii(docs).collect()}
    assert got[0] == got[40] == "The password: [SECRET] opens it." and got[41] == "The secret = '[SECRET]' opens it."
    assert token("x", 300)[:100] not in got[42] and token("y", 300)[-100:] not in got[42] and "[CARD]" in got[42]
    assert got[42].startswith("The password: [SECRET]") and got[42].endswith("[SECRET] opens it.")
