"""Self-descriptions of small trees."""

import hashlib

import pytest

from changelens import schemas
from changelens.operators import charter, describe, lookups
from changelens.sources import metadata

PYPROJECT = """[project]
name = "invoicer"
version = "1.2.0"
description = "Turns orders into **invoices**"
requires-python = ">=3.10"
license = {text = "MIT"}
keywords = ["orders", "invoices"]
classifiers = ["Intended Audience :: Developers", "License :: Other"]
dependencies = ["Foo_Bar>=1", "baz"]
[project.scripts]
invoice = "invoicer.cli:main"
[tool.ruff]
line-length = 100
[tool.poetry.group.test.dependencies]
pytest = "^7.1"
"""
TREE = {
    "pyproject.toml": PYPROJECT,
    "package.json": '{"name": "other", "version": "9", "bin": "x.js", "engines": {"node": ">=18"}, "dependencies": {"Left": "1"}}',
    "README.md": "# Invoicer\nIt turns orders into invoices for small shops.\n\n## Features\n- Prints invoices as one page\n",
    "CONTRIBUTING.md": "- Every change comes with a test of its own\n- short\n",
    "LICENSE": "\n  The Own License  \nmore",
    "CHANGELOG.md": "",
    "src/invoicer/__init__.py": '"""Orders become invoices."""\n',
    "src/invoicer/__main__.py": "x = 1\n",
    "src/invoicer/core/__init__.py": '"""The core of it.\n\nMore."""\n',
    "src/invoicer/tax.py": '"""Short."""\n',
    "src/invoicer/broken.py": "def (",
    "cmd/tool/main.go": "package main",
    "tests/b/test_a.py": "",
    "tests/a.py": "",
    ".github/workflows/ci.yml": "steps:\n  - run: pytest -q\n  - run: curl x | sh test\n  - run: 'make check'\n  - run: pytest -q\n",
    "Makefile": "test: x\n\tpytest\nall:\n",
}


@pytest.fixture(scope="module")
def files(spark):
    own = [("a/invoicer", p, c) for p, c in TREE.items()]
    own += [("a/bare", "x.txt", None), ("a/broken", "pyproject.toml", "project = ["), ("a/broken", "package.json", "[1]"), ("a/odd", "pyproject.toml", "project = 3\n[tool]\npoetry = 1\n")]
    return spark.createDataFrame(own, "repo STRING, path STRING, content STRING").cache()


def test_described(spark, files):
    snaps = spark.createDataFrame([(r, "1", 1, "python", 0.0) for r in ("a/invoicer", "a/bare", "a/broken", "a/odd")], "repo STRING, sha STRING, number INT, toolchain STRING, built_at DOUBLE")
    api = spark.createDataFrame([("a/invoicer", "b"), ("a/invoicer", "a"), ("a/invoicer", "a")], "repo STRING, symbol STRING")
    out = describe.described(files, snaps, api)
    assert out.columns == schemas.schema("charters").names
    got = {r.repo: r for r in out.collect()}
    assert len(got) == 4
    r = got["a/invoicer"]
    assert (r.name, r.version, r.license, r.summary) == ("invoicer", "1.2.0", "MIT", "Turns orders into invoices")
    assert r.entry_points == ["invoice = invoicer.cli:main", "invoicer = x.js", "python -m invoicer", "tool = cmd/tool"]
    assert r.dependencies == ["baz", "foo-bar", "left"] and r.standards == ["ci", "ruff"] and r.public_api == ["a", "b"]
    assert [tuple(m) for m in r.modules] == [("invoicer", "Orders become invoices.", "src/invoicer/__init__.py:1"), ("invoicer.core", "The core of it.", "src/invoicer/core/__init__.py:1")]
    claims = [tuple(c) for c in r.claims]
    assert claims[0] == ("summary", "Turns orders into invoices", "pyproject.toml:4")
    assert claims[1:5] == [
        ("target", "Python >=3.10", "pyproject.toml:5"),
        ("target", "Intended Audience: Developers", "pyproject.toml:8"),
        ("target", "Keywords: orders, invoices", "pyproject.toml:7"),
        ("capability", "Command invoice runs invoicer.cli:main", "pyproject.toml:11"),
    ]
    assert ("capability", "Prints invoices as one page", "README.md:5") in claims
    assert ("constraint", "Every change comes with a test of its own", "CONTRIBUTING.md:1") in claims
    assert claims[-1] == ("capability", "invoicer.core: The core of it.", "src/invoicer/core/__init__.py:1")
    for repo in ("a/bare", "a/broken", "a/odd"):
        b = got[repo]
        assert (b.name, b.summary, b.claims, b.entry_points, b.dependencies, b.license) == (repo[2:], "", [], [], [], "")
    assert describe.described(files.limit(0), snaps, api).count() == 4
    heads = spark.createDataFrame([("a/invoicer", "1"), ("a/bare", "2")], "repo STRING, sha STRING")
    assert [x.repo for x in describe.to_refresh(heads, out).collect()] == ["a/bare"]
    assert describe.to_refresh(heads, out, force=True).count() == 2


def test_commands_tools_norms(spark, files):
    got = sorted((r.pos, r.command) for r in metadata.test_commands(files).collect())
    assert got == [(1, ["sh", "-c", "pytest -q"]), (2, ["sh", "-c", "make check"]), (3, ["make", "test"])]
    assert [tuple(r) for r in metadata.dev_requirements(files).collect()] == [("a/invoicer", ["pytest>=7.1,<8"])]
    tools = {r.repo: tuple(r)[1:] for r in metadata.declared_tooling(files).collect()}
    assert tools["a/invoicer"] == ("ruff", None, None, "CHANGELOG.md") and tools["a/bare"] == (None,) * 4
    lints = spark.createDataFrame([("a/invoicer", "ruff"), ("a/invoicer", "mypy")], "repo STRING, tool STRING")
    norms = {r.id: (r.statement, r.evidence) for r in charter.declared_norms(charter.declared(files, lints)).collect()}
    assert norms == {
        "declared-lint-ruff": ("Code must pass the repository's own ruff configuration.", "pyproject.toml:12"),
        "declared-changelog": ("Changes to the public API are recorded in CHANGELOG.md.", "CHANGELOG.md:1"),
        "declared-tests": ("Changes keep the repository's own test suite passing, and new code is exercised by it.", "tests/a.py:1"),
    }
    assert [tuple(r) for r in metadata.license_line(files).collect()] == [("a/invoicer", "The Own License")]


def test_manifests():
    assert [f[:2] for f in metadata.go_mod("module x/y\ngo 1.2\nrequire (\n a/B v1\n c v2 // indirect\n)\nrequire d v1\n")] == [("name", "x/y"), ("target", "Go 1.2"), ("dependency", "a/b"), ("dependency", "d")]
    cargo = '[package]\nname = "k"\nversion = "0.1"\nrust-version = "1.70"\n[dependencies]\nSerde = "1"\n[[bin]]\nname = "kk"\n'
    assert [f[:2] for f in metadata.MANIFESTS["Cargo.toml"](cargo)] == [("name", "k"), ("version", "0.1"), ("target", "Rust 1.70"), ("dependency", "serde"), ("entry_point", "kk = src/main.rs")]
    cfg = "[metadata]\nname = n\ndescription = d\n[options]\npython_requires = >=3\ninstall_requires =\n  A_b>1\n  c\n"
    assert [f[:2] for f in metadata.MANIFESTS["setup.cfg"](cfg)] == [("name", "n"), ("summary", "d"), ("target", "Python >=3"), ("dependency", "a-b"), ("dependency", "c")]
    assert list(metadata.MANIFESTS["setup.cfg"]("no section")) == [] and list(metadata.MANIFESTS["package.json"]("[")) == [] and list(metadata.MANIFESTS["Cargo.toml"]("")) == []
    req = lambda name, spec: [r.line for r in metadata.requirements(name, spec)]
    assert req("x", {"version": "~1.2", "extras": ["q"], "python": ">=3.8", "markers": "os_name == 'nt'"}) == ["x[q]>=1.2,<1.3 ; (python_full_version >= '3.8') and (os_name == 'nt')"]
    assert req("python", "^3.8") == req("y", {"git": "u"}) == [] and req("z", ["*", {"version": "1"}]) == ["z", "z==1"]


def test_image_key(spark, files):
    ddl = "repo STRING, id STRING, base_image STRING, setup_lines ARRAY<STRING>, install ARRAY<STRING>, lockfiles ARRAY<STRING>, binaries ARRAY<STRING>"
    packs = spark.createDataFrame([("a/invoicer", "py", "img", ["s"], ["pip install ."], ["LICENSE", "absent.lock"], ["b", "a"])], ddl)
    want = hashlib.sha256(f"pyimgspip install .LICENSE\0{TREE['LICENSE']}\0absent.lock\0\0a\0b\x001".encode()).hexdigest()
    assert metadata.image_key(packs, files).first().image_key == want


def test_notes(spark):
    ddl = schemas.schema("charters")
    row = dict(repo="r", sha="1", number=1, name="invoicer", summary="turns orders into invoices", claims=[], version="", license="", toolchain="python", entry_points=["inv = invoicer.cli:main"], modules=[("invoicer", "all", "i:1"), ("invoicer.core", "the core", "c:1")], public_api=["invoicer.core.total"], dependencies=[], standards=[], built_at=0.0)
    own = spark.createDataFrame([tuple(row[f] for f in ddl.names)], ddl)
    obs = spark.createDataFrame(
        [("1", "timeout", "x.y", "c", "x/y.py::t"), ("2", "api_change", "invoicer.core.total", "c", "src/invoicer/core.py:3"), ("3", "api_change", "other.f", "c", "x.py:1"), ("4", "lint_regression", "x", "c", "tests/x.py:1"), ("5", "lint_regression", "invoicer.cli:main", "c", "q.py:1"), ("6", "lint_regression", None, "c", "src/invoicer/core/a.py:1"), ("7", "lint_regression", "q", None, None)],
        "id STRING, kind STRING, symbol STRING, what_changed STRING, evidence_ref STRING",
    )
    got = {r.id: (r.relevance, r.relevance_note) for r in charter.grounded(obs, own, "r").collect()}
    core = " — in invoicer.core: “the core” (c:1)"
    assert got == {
        "1": ("core", "changes what the program does — invoicer is for: “turns orders into invoices”"),
        "2": ("core", "part of the public surface invoicer exposes" + core),
        "3": ("supporting", "not in the public surface this charter records"),
        "4": ("peripheral", "in tests/x.py, outside the product itself"),
        "5": ("core", "reached from the `inv` command — in invoicer: “all” (i:1)"),
        "6": ("supporting", "inside invoicer's own code" + core),
        "7": ("supporting", "inside the repository's own code"),
    }
    symbols = spark.createDataFrame([("src.invoicer.core.f",), ("invoicer.cli",), ("other",), ("",)], "symbol STRING")
    modules = spark.createDataFrame([(0, "invoicer", "all"), (1, "invoicer.core", "the core"), (2, "core", "c")], "pos INT, module STRING, doc STRING")
    assert sorted(tuple(r) for r in lookups.module_for(symbols, modules).collect()) == [("invoicer.cli", "invoicer", "all"), ("src.invoicer.core.f", "invoicer.core", "the core")]
