"""Pages in six layouts that html_training doesn't make, with the text that an extraction should give."""

import random

NOUNS = "harbour winter engine garden letter village theatre river market doctor mountain window kitchen season captain library evening pattern island bridge".split()
VERBS = "carries follows repairs remembers crosses watches measures collects describes opens".split()


class OtherPages:
    def __init__(self, seed):
        self.r = random.Random(seed)

    def sentence(self, low=6, high=24):
        w = ["The", self.r.choice(NOUNS), self.r.choice(VERBS)] + [self.r.choice(["the", "a", "every", "no", "old", "near"] + NOUNS) for _ in range(self.r.randint(low, high))]
        return " ".join(w) + self.r.choice(".....?!")

    def title(self):
        return " ".join(self.r.choice(NOUNS).capitalize() for _ in range(self.r.randint(2, 6)))

    def paragraph(self):
        return " ".join(self.sentence() for _ in range(self.r.randint(1, 5)))

    def menu(self, n=None):
        return "".join(f'<li class="item-{i}"><a href="/{i}">{self.title()}</a></li>' for i in range(n or self.r.randint(3, 8)))

    def body(self, heading="h1", cls=""):
        """(markup, blocks) of an article."""
        r, title = self.r, self.title()
        out, blocks = [f"<{heading}{cls}>{title}</{heading}>"], [title]
        for _ in range(r.randint(2, 8)):
            x = r.random()
            if x < 0.7:
                p = self.paragraph()
                out.append(f"<p{cls}>{p}</p>")
                blocks.append(p)
            elif x < 0.8:
                h = self.title()
                out.append(f"<h2{cls}>{h}</h2>")
                p = self.paragraph()
                out.append(f"<p{cls}>{p}</p>")
                blocks += [h, p]
            elif x < 0.9:
                items = [self.sentence() for _ in range(r.randint(2, 4))]
                out.append("<ul>" + "".join(f"<li>{i}</li>" for i in items) + "</ul>")
                blocks += items
            else:
                q = self.sentence()
                out.append(f"<blockquote><p>{q}</p></blockquote>")
                blocks.append(q)
        return "".join(out), blocks

    def blog(self):
        a, blocks = self.body(cls=' class="wp-block"')
        comments = "".join(f'<li class="comment even"><div class="comment-author vcard"><b>{self.title()}</b></div><p>{self.paragraph()}</p></li>' for _ in range(self.r.randint(0, 5)))
        menu = self.menu()
        return (
            f'<body class="post-template-default single single-post has-sidebar comments-open"><div id="page" class="site"><a class="skip-link" href="#content">Skip to content</a>'
            f'<header id="masthead" class="site-header"><div class="site-branding"><p class="site-title"><a href="/">{self.title()}</a></p></div><nav id="site-navigation" class="main-navigation"><ul id="primary-menu">{menu}</ul></nav></header>'
            f'<div id="content" class="site-content"><main id="main" class="site-main"><article id="post-12" class="post-12 post type-post hentry"><div class="entry-content">{a}</div></article>'
            f'<div id="comments" class="comments-area"><h2 class="comments-title">Thoughts</h2><ol class="comment-list">{comments}</ol></div></main>'
            f'<aside id="secondary" class="widget-area"><section class="widget"><h2 class="widget-title">Recent</h2><ul>{self.menu()}</ul></section></aside></div>'
            f'<footer id="colophon" class="site-footer"><div class="site-info">Made with care in {self.title()}</div></footer></div></body>'
        ), blocks

    def grid(self):
        a, blocks = self.body()
        return (
            f'<div class="container-fluid"><nav class="navbar navbar-expand-lg"><a class="navbar-brand" href="/">{self.title()}</a><ul class="navbar-nav">{self.menu()}</ul></nav>'
            f'<div class="row"><div class="col-md-8">{a}</div><div class="col-md-4"><div class="card sidebar-card"><h5>Most read</h5><ul class="list-unstyled">{self.menu()}</ul></div></div></div>'
            f'<div class="footer mt-5"><p>&copy; 2019 {self.title()}</p></div></div>'
        ), blocks

    def table(self):
        a, blocks = self.body()
        return f'<table width="100%"><tr><td colspan="2" class="masthead"><a href="/">{self.title()}</a></td></tr><tr><td class="leftmenu"><ul>{self.menu()}</ul></td><td>{a}</td></tr></table><div class="copyright">Copyright {self.title()}</div>', blocks

    def manual(self):
        a, blocks = self.body()
        return f'<div class="topbar"><a href="/">{self.title()}</a><form action="/s"><input name="q"><button>Search</button></form></div><div class="toc menu" role="navigation"><ul>{self.menu()}</ul></div><div role="main"><div class="section" id="intro">{a}</div></div><div class="footer">Built on {self.title()}</div>', blocks

    def bare(self):
        a, blocks = self.body()
        return f'<center><a href="/">{self.title()}</a></center>' * 0 + f"{a}<hr><footer><address>Written by hand, {self.title()}</address></footer>", blocks

    def hashed(self):
        a, blocks = self.body(cls=' class="pw-x ab12"')
        return f'<div id="root"><div class="a1 b2"><div class="c3"><header><div class="d4"><a href="/">{self.title()}</a><button>Sign in</button></div></header><article><section class="e5"><div class="f6 g7">{a}</div></section></article><footer class="h8"><div class="i9"><a href="/about">About</a> <a href="/terms">Terms</a></div></footer></div></div><div class="cookie-dialog" role="dialog"><p>{self.sentence()}</p><button>Accept</button></div></div>', blocks

    def page(self):
        html, blocks = self.r.choice([self.blog, self.grid, self.table, self.manual, self.bare, self.hashed])()
        return f"<!DOCTYPE html><html><head><title>{blocks[0]}</title><script>var a = '<p>';</script></head>{html}</html>", "\n".join(blocks)
