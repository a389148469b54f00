"""Text of pages that are built around known pieces."""

import random

from sievemill.operators.markup import drop_markup, text_of


def page(r):
    """(a page, its pieces of text)."""
    out, pieces, tags = [], [], []
    for _ in range(r.randint(1, 40)):
        kind = r.randrange(8)
        if kind <= 2:
            piece = "".join(r.choices("ab é<>&\"' x\n", k=r.randint(1, 8)))
            out.append(piece.replace("&", r.choice(["&amp;", "&#38;", "&#x26;"])).replace("<", r.choice(["&lt;", "&#60;"])).replace(">", "&gt;"))
            if pieces and pieces[-1] is not None and out[-2:-1] and not out[-2].startswith("<"):
                pieces[-1] += piece
            else:
                pieces.append(piece)
        elif kind == 3:
            tags.append(r.choice(["p", "b", "DIV", "a"]))
            out.append(f"<{tags[-1]} title=\"x > y\" alt='</p><!-- \"' data=1>")
            pieces.append(None)
        elif kind == 4 and tags:
            out.append(f"</{tags.pop()} >")
            pieces.append(None)
        elif kind == 5:
            out.append("<!-- <b>no text</b> > - -->")
            pieces.append(None)
        elif kind == 6:
            name = r.choice(["script", "style", "SCRIPT"])
            out.append(f"<{name} type='t'>if (a < b && c > d) {{ '<b>no</b>' }}</{name}>")
            pieces.append(None)
        else:
            out.append(r.choice(["<br/>", "<img src='a>b'>", "<!DOCTYPE html>"]))
            pieces.append(None)
    return "".join(out), [p for p in pieces if p is not None]


def test_pages_give_back_their_pieces():
    r = random.Random(4)
    for _ in range(500):
        html, pieces = page(r)
        assert text_of(html, "\x00").replace("\x00", "") == "".join(pieces), html


def test_odd_pages(spark):
    rows = [(1, None), (2, ""), (3, "<p>a</p><p>b&nbsp;c&eacute;</p>"), (4, "no tags & no end <b"), (5, "<script>x"), (6, "a<!-- open"), (3, "<p>a</p>" * 2000)]
    df = spark.createDataFrame(rows, "id long, html string")
    got = drop_markup(df, "html")
    assert got.columns == ["id", "html"]
    texts = [(x.id, x.html) for x in got.collect()]
    assert (1, "") in texts and (2, "") in texts and (3, "a b cé") in texts and (3, " ".join("a" * 2000)) in texts and (5, "") in texts
    assert drop_markup(df.limit(0), "html").collect() == []
