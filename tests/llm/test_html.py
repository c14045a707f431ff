import random

import pytest

from foliograph.llm import html_render as hr

CASES = {
    "<p>a<p>b": "a\n\nb",
    "<div>a</div><div>b</div>c": "a\nb\nc",
    "x <b>bold<i>er</b> y</i>": "x bolder y",
    "a<br>b<br><br>c": "a\nb\n\nc",
    "<ul><li>one<li>two<ol start=3><li>x<li>y</ol><li>three</ul>": "- one\n- two\n  3. x\n  4. y\n- three",
    "<table><tr><th>name<th>n<tr><td>a long one<td>1<tr><td>b<td>22</table>": "name       | n\na long one | 1\nb          | 22",
    "<table><tr><td colspan=2>wide cell</td><td>z</td></tr><tr><td>a</td><td>b</td><td>c</td></tr></table>": "wide cell | z\na | b | c",
    "<td>loose": "loose",
    "<table><td>a<td>b</table>": "a | b",
    "<table><tr><td>日本</td><td>x</td></tr><tr><td>abcd</td><td>y</td></tr></table>": "日本 | x\nabcd | y",
    "<script>var t='</p>';</script>a<style>p{}</style><!-- no --><noscript>n</noscript>b": "ab",
    "<title>t</title><body>x": "x",
    "<p hidden>h</p><p style='color:red; display : none'>d</p><p style=visibility:hidden>v</p>s": "s",
    "<dialog>closed</dialog><dialog open>open</dialog>": "open",
    "<pre>  a\n   b</pre>c": "  a\n   b\n\nc".strip("\n"),
    "&lt;p&gt; &amp;amp; &eacute; &#x41;": "<p> &amp; é A",
    "<img alt='pic'> <input type=submit value=Go><input value=no>": "pic Go",
    "<select><option>a<option>b</select>": "a\nb",
    "<dl><dt>t<dd>d<dt>u<dd>e</dl>": "t\n  d\nu\n  e",
    "<blockquote>q<p>r</blockquote>s": "  q\n\n  r\n\ns",
    "a</p>b": "a\n\nb",
    "<h1>H</h1><p>x</p><hr>y": "H\n\nx\n\n---\n\ny",
    "<a href=\"x>y\">link</a> <b unclosed='q": "link",
    "3 < 5 and <3": "3 < 5 and <3",
    "": "",
    "<div style='visibility:hidden'>h<b style='visibility: visible'>v</b>h</div>w": "v\nw",
    "a <svg><title>t</title><defs><text>d</text></defs><rect/><g><text x=1>one</text><text>two</text></g></svg> b": "a one two b",
    "<svg><text>x<tspan>y</tspan></text><g hidden><text>z</text></g></svg>": "xy",
    "<math><mi>a</mi><mo>+</mo><mi>b</mi><annotation>tex</annotation></math>": "a+b",
    "<object><p>fallback</object>c": "c",
}


# --- documents made from a model, rendered by rules written down once more -----


def words_of(rng):
    return " ".join(rng.choice(["alpha", "b", "señal", "日本", "x1", "&amp;"]) for _ in range(rng.randint(1, 6)))


def model_of(rng, depth=0):
    kinds = ["p", "div", "h", "pre", "hidden", "hr"] + ["list", "table", "quote"] * (depth < 2)
    made = []
    for _ in range(rng.randint(1, 4)):
        kind = rng.choice(kinds)
        if kind == "list":
            made.append((kind, rng.random() < 0.5, [(words_of(rng), [model_list(rng)] if rng.random() < 0.3 else []) for _ in range(rng.randint(1, 4))]))
        elif kind == "table":
            cols = rng.randint(1, 4)
            made.append((kind, [[words_of(rng) for _ in range(cols)] for _ in range(rng.randint(1, 4))]))
        elif kind == "quote":
            made.append((kind, model_of(rng, depth + 1)))
        elif kind == "pre":
            made.append((kind, [" " * rng.randint(0, 3) + "line" + str(k) for k in range(rng.randint(1, 3))]))
        else:
            made.append((kind, words_of(rng)))
    return made


def model_list(rng):
    return ("list", rng.random() < 0.5, [(words_of(rng), []) for _ in range(rng.randint(1, 3))])


def page_of(nodes, rng):
    """The model as markup, end tags left out where they are implied."""
    out = ""
    for kind, *rest in nodes:
        end = lambda tag: rng.choice(["", f"</{tag}>"])
        if kind == "p":
            out += f"<p>{rest[0]}</p>" if rng.random() < 0.5 else f"<P class=x>\n {rest[0].replace(' ', '  ')}</p>"
        elif kind == "div":
            out += f"<div><b>{rest[0]}</b></div>"
        elif kind == "h":
            out += f"<h2>{rest[0]}</h2>"
        elif kind == "pre":
            out += "<pre>" + "\n".join(rest[0]) + "</pre>"
        elif kind == "hidden":
            out += rng.choice(["<div hidden>{}</div>", "<script>{}</script>", "<!-- {} -->", "<p style='display:none'>{}</p>"]).format(rest[0])
        elif kind == "hr":
            out += "<hr>"
        elif kind == "quote":
            out += f"<blockquote>{page_of(rest[0], rng)}</blockquote>"
        elif kind == "list":
            tag = "ol" if rest[0] else "ul"
            out += f"<{tag}>" + "".join(f"<li>{w}{page_of(sub, rng)}{end('li')}" for w, sub in rest[1]) + f"</{tag}>"
        else:
            out += "<table>" + "".join("<tr>" + "".join(f"<td>{c}{end('td')}" for c in row) + end("tr") for row in rest[0]) + "</table>"
    return out


def lines_of(nodes, nested=False):
    """The lines that the model is shown as; None is an empty line asked for."""
    out = []
    for kind, *rest in nodes:
        said = rest[0].replace("&amp;", "&") if rest and isinstance(rest[0], str) else None
        if kind in ("p", "h"):
            out += [None, said, None]
        elif kind == "div":
            out += [said]
        elif kind == "hr":
            out += [None, "---", None]
        elif kind == "pre":
            out += [None, *rest[0], None]
        elif kind == "quote":
            out += [None, *(x and "  " + x for x in lines_of(rest[0])), None]
        elif kind == "list":
            out += [] if nested else [None]
            for n, (w, sub) in enumerate(rest[1], 1):
                mark = f"{n}. " if rest[0] else "- "
                out += [mark + w.replace("&amp;", "&"), *(x and " " * len(mark) + x for x in lines_of(sub, True))]
            out += [] if nested else [None]
        elif kind == "table":
            rows = [[c.replace("&amp;", "&") for c in row] for row in rest[0]]
            wide = lambda c: sum(2 if "\u2e80" <= x <= "\u9fff" else 1 for x in c)
            room = [max(wide(row[k]) for row in rows) for k in range(len(rows[0]))]
            out += [None, *(" | ".join(c + " " * (room[k] - wide(c)) for k, c in enumerate(row)).rstrip() for row in rows), None]
    return out


def shown(nodes):
    text, gap = [], False
    for line in lines_of(nodes):
        if line is None:
            gap = True
            continue
        if gap and text:
            text.append("")
        text.append(line)
        gap = False
    return "\n".join(text)


@pytest.mark.parametrize("seed", range(60))
def test_against_the_rules_on_made_pages(seed):
    rng = random.Random(seed)
    for _ in range(10):
        model = model_of(rng)
        page = page_of(model, rng)
        assert hr.html_text(page) == shown(model), page


@pytest.mark.parametrize("page", CASES)
def test_rendering(page):
    assert hr.html_text(page) == CASES[page]


def test_all_visible_words_come_out():
    rng = random.Random(2)
    tags = "div p b i ul li table tr td th span section h2 a pre blockquote ol dl dt dd select option".split()
    for _ in range(300):
        words, page = [], ""
        for k in range(rng.randint(1, 40)):
            page += rng.choice(["", f"<{rng.choice(tags)}>", f"</{rng.choice(tags)}>", f"<{rng.choice(tags)} class='x y'>", "<!-- c -->"])
            if rng.random() < 0.6:
                words.append(f"w{k}")
                page += f" w{k} "
        found = hr.html_text(page).replace("|", " ").split()
        assert [w for w in found if w[0] == "w" and w[1:].isdigit()] == words or sorted(w for w in found if w[0] == "w") == sorted(words), page


def test_deep_and_wild_pages():
    assert hr.html_text("<div>" * 50_000 + "x") == "x"
    assert hr.html_text("<b><p>" * 3000 + "y").strip() == "y"
    assert hr.html_text("<" * 5000).count("<") == 5000


def test_dataframe(spark):
    df = spark.createDataFrame([(1, "<p>a", "u"), (None, None, None), (2, "", "u"), (2, "", "u")], "page_id long, html string, text string")
    assert sorted(map(str, ((r["page_id"], r["text"]) for r in hr.extract(df).collect()))) == sorted(map(str, [(1, "a"), (None, ""), (2, ""), (2, "")]))
    assert hr.extract(df.limit(0)).collect() == []
