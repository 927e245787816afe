"""Pages whose article must come out whole, and whose frame must not."""

import random

import pytest

from lexiforge.llm import extraction

LONG = ["This is a long paragraph of the article, with a good many words in it and some commas, too.", "Another one follows it, and says more about the same things at some length.", "The third is no shorter than the others, and holds no link either.", "At the end there is a fourth one, so that the section has weight."]


def paragraphs(*texts):
    return "".join(f"<p>{t}</p>" for t in texts)


@pytest.mark.parametrize(
    ("page", "expected"),
    [
        (f"<body><div><section>{paragraphs(*LONG)}</section><section><h2>Next</h2><p>Short line.</p></section><section><h2>Last</h2>{paragraphs(LONG[0])}</section></div></body>", [*LONG, "Next", "Short line.", "Last", LONG[0]]),
        (f"<body><h1>Title</h1><div>{paragraphs(*LONG[:3])}</div><p>Second short closing.</p><div><p>Other part of article here.</p></div></body>", ["Title", *LONG[:3], "Second short closing.", "Other part of article here."]),
        (f"<article>{paragraphs(*LONG)}<h2>References</h2><ul><li><a href=a>First title of a work</a><li><a href=b>Second title</a></ul></article>", [*LONG, "References", "First title of a work", "Second title"]),
        (f"<div>{paragraphs(*LONG)}<h2>References</h2><ul><li><a href=a>First title of a work</a><li><a href=b>Second title</a></ul></div>", [*LONG, "References", "First title of a work", "Second title"]),
        (f"<body>{paragraphs(*LONG[:2])}<ul><li><a href=a>Tool A</a><li><a href=b>Tool B</a> fast</ul>{paragraphs(*LONG[2:])}</body>", [*LONG[:2], "Tool A", "Tool B fast", *LONG[2:]]),
        (f"<article>{paragraphs(*LONG)}<div><p>See <a href=a>the first long title</a> and <a href=b>the second long title</a>.</p></div></article>", [*LONG, "See the first long title and the second long title."]),
        ("<article><p>One sentence only.</p></article><div class='comments'>" + paragraphs(*LONG * 8) + "</div>", ["One sentence only."]),
        ("<body><p>One sentence only.</p><section id='comment-list'>" + paragraphs(*LONG * 8) + "</section></body>", ["One sentence only."]),
        ("<body><div class='comments'>" + paragraphs(*LONG) + "</div></body>", LONG),  # nothing else is left
        (f"<article><p>Press <button>Start</button> and wait.</p>{paragraphs(*LONG)}<button>Buy</button></article>", ["Press Start and wait.", *LONG]),
        (f"<body><article>{paragraphs(*LONG)}</article><article>{paragraphs(*LONG[:1])}</article><div>© 2024 Example</div></body>", [*LONG, LONG[0]]),
        (f"<body><div><a href=a>Home</a> | <a href=b>News</a></div><h1>Title</h1>{paragraphs(*LONG)}<div><a href=c>Privacy</a> <a href=d>Terms</a></div></body>", ["Title", *LONG]),
        (f"<body><div id=page><div><a href=a>Home</a> <a href=b>News</a></div>{paragraphs(*LONG)}</div><div>(c) us</div></body>", LONG),
        (f"<body><main><article>{paragraphs(*LONG)}</article></main><div>Buy this.</div></body>", LONG),
        (f"<div><div><div>{paragraphs(*LONG)}</div></div>A loose end.<div><p>And more.</p></div></div>", [*LONG, "A loose end.", "And more."]),
    ],
)
def test_articles_come_out_whole(page, expected):
    assert extraction.main_text(page).split("\n") == expected


def test_random_articles_in_wrappers():
    """Blocks of an article in any wrappers, with a frame around: all of the article, nothing of the frame."""
    rnd = random.Random(8)

    def block(k):
        text = f"Number {k}: " + " ".join(rnd.choice(["some", "more", "words", "of", "text,", "here"]) for _ in range(rnd.choice([1, 4, 20, 60]))) + "."
        tag = rnd.choice(["p", "p", "p", "h2", "blockquote"])
        return f"<{tag}>{text}</{tag}>", text

    for _ in range(300):
        blocks = [block(k) for k in range(rnd.randrange(3, 15))]
        texts, html = [t for _, t in blocks], ""
        while blocks:
            size = rnd.randrange(1, 5)
            part, blocks = "".join(b for b, _ in blocks[:size]), blocks[size:]
            html += rnd.choice(["{}", "<div>{}</div>", "<section>{}</section>", "<div><div>{}</div></div>"]).format(part)
        html = rnd.choice(["{}", "<div>{}</div>", "<article>{}</article>", "<main><div>{}</div></main>", "<div class='story'><section>{}</section></div>"]).format(html)
        page = f"<body><nav><a href=a>Home</a></nav><div class=ad>Buy this thing.</div>{html}<div class='comments'>{paragraphs(*LONG)}</div><footer>us</footer></body>"
        assert extraction.main_text(page).split("\n") == texts, page
