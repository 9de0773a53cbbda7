"""Globs and the listing of folders."""

import pytest

from palisade.sources import files as src
from palisade.sources.globs import Wanted, expanded, listed, local_entries, store_entries

CASES = [
    # glob, taken, not taken
    ("*.md", ["a.md", "a b.md"], ["a/b.md", ".a.md", "a.mdx"]),
    ("**/*.md", ["a.md", "a/b.md", "a/b/c.md"], [".a/b.md", "a/.b.md", "a.MD"]),
    ("a/**", ["a/b", "a/b/c.d"], ["b/a", "ab/c", "a/.b"]),
    ("**/a/**", ["a/b", "x/a/b/c"], ["xa/b", "a/.x"]),
    ("a/**/b.md", ["a/b.md", "a/x/y/b.md"], ["b.md", "a/xb.md"]),
    ("**", ["a", "a/b"], [".a", "a/.b"]),
    ("?.md", ["a.md", "é.md"], ["ab.md", ".md"]),
    ("a?c/*", ["abc/d"], ["ac/d", "a/c/d"]),
    ("[abc].md", ["a.md", "c.md"], ["d.md", "ab.md"]),
    ("[a-c]x", ["bx"], ["dx", "-x"]),
    ("[!a-c]x", ["dx"], ["ax", "/x"]),
    ("[^a]", ["b"], ["a"]),
    ("[[:digit:]]*", ["1a", "9"], ["a1"]),
    ("[[:upper:]_-]x", ["Ax", "_x", "-x"], ["ax"]),
    ("*.{ts,js}", ["a.ts", "b.js"], ["a.tsx", "a.{ts,js}"]),
    ("*.{ts,j{s,son}}", ["a.ts", "a.js", "a.json"], ["a.jso"]),
    ("{a,b/{c,d}}/*.md", ["a/x.md", "b/c/x.md", "b/d/x.md"], ["b/x.md"]),
    ("{,x/}*.md", ["a.md", "x/a.md"], ["y/a.md"]),
    ("f{1..3}.md", ["f1.md", "f3.md"], ["f4.md", "f0.md"]),
    ("{a}.md", ["{a}.md"], ["a.md"]),
    ("@(a|b).md", ["a.md", "b.md"], ["c.md", "ab.md"]),
    ("?(a|b)c", ["c", "ac", "bc"], ["abc"]),
    ("+(ab)c", ["abc", "ababc"], ["c"]),
    ("*(ab)c", ["c", "ababc"], ["ac"]),
    ("!(a|b).md", ["c.md", "ab.md"], ["a.md", "b.md", ".c.md"]),
    ("src/!(test)/*.ts", ["src/x/a.ts", "src/tests/a.ts"], ["src/test/a.ts"]),
    (".github/*.yml", [".github/a.yml"], ["github/a.yml", ".github/.a.yml"]),
    ("**/.*", [".a", "x/.b"], ["a", ".x/.b"]),
    (r"\*.md", ["*.md"], ["a.md"]),
    (r"a\[1\]+.md", ["a[1]+.md"], ["a1.md"]),
    ("a+(1).md", ["a1.md", "a11.md"], ["a+(1).md"]),
    ("./a//b.md", ["a/b.md"], ["b.md"]),
]


@pytest.mark.parametrize("glob,taken,left", CASES)
def test_glob(glob, taken, left):
    wanted = Wanted([glob], [])
    assert [p for p in taken if not wanted.file(p)] == [] and [p for p in left if wanted.file(p)] == []
    # every folder on the way to a wanted path is listed
    assert all(wanted.folder("/".join(p.split("/")[:k])) for p in taken for k in range(1, p.count("/") + 1))


def test_include_and_exclude():
    wanted = Wanted(["**/*.md", "!**/no/**", "!(x).txt"], ["**/.git/**", "**/*.min.md", "old/**"])
    assert wanted.file("a/b.md") and wanted.file("y.txt")
    assert not any(map(wanted.file, ("no/a.md", "a/no/b/c.md", "x.min.md", "old/a.md", "x.txt")))
    assert [wanted.folder(f) for f in ("a", "a/b", "no", "a/no", ".git", "old", "old/x", "cold")] == [True, True, False, False, False, False, False, True]
    assert Wanted(["src/*.md"], []).folder("src") and not Wanted(["src/*.md"], []).folder("lib") and not Wanted(["src/*.md"], []).folder("src/x")
    # excluding globs take names with a dot as well
    assert not Wanted(["**/.*"], ["**/a/*"]).file("a/.x") and expanded("${a,b}") == ["${a,b}"]


def test_only_needed_folders_are_listed(spark, tmp_path):
    for p in ("a.md", "x/b.ts", "x/y/[1]{2}*?.md", "x/node_modules/deep/er/c.ts", ".git/objects/d.md", "dist/e.md", "x/.hidden/f.md"):
        (tmp_path / p).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / p).write_text(f"you must {p}")
    (tmp_path / "link.md").symlink_to(tmp_path / "a.md")
    seen, entries = [], local_entries(str(tmp_path))
    found = list(listed(lambda f: seen.append(f) or entries(f), Wanted(src.INCLUDE, src.EXCLUDE)))
    assert sorted(found) == ["a.md", "x/b.ts", "x/y/[1]{2}*?.md"] and sorted(seen) == ["", "x", "x/y"]
    for root in (str(tmp_path), f"file://{tmp_path}"):
        got = {r.path: r.content for r in src.read_files(spark, root).collect()}
        assert got == {p: f"you must {p}" for p in found}
    assert src.read_files(spark, str(tmp_path), include=("*.none",)).count() == 0
    (tmp_path / "link.md").unlink()
    assert sorted(listed(store_entries(spark, f"file://{tmp_path}"), Wanted(src.INCLUDE, src.EXCLUDE))) == sorted(found)
