"""What a file's path says: role, language, module, exclusion."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

# Names, extensions and folders that decide a file's role.
CONFIG_NAMES = [
    "Makefile", "Rakefile", "Taskfile.yml", "Justfile", ".golangci.yml", ".eslintrc.json", ".prettierrc",
    "tsconfig.json", "package.json", "go.mod", "go.sum", "Cargo.toml", "Cargo.lock", "pyproject.toml", "setup.py",
    "Gemfile", "Gemfile.lock", "requirements.txt", "pom.xml", ".gitignore", ".dockerignore", ".editorconfig",
]
CONFIG_EXTENSIONS = [".toml", ".ini", ".cfg"]
DOC_EXTENSIONS = [".md", ".rst", ".adoc", ".txt"]
DOC_NAMES = ["LICENSE", "NOTICE", "AUTHORS", "CHANGELOG", "CONTRIBUTING"]
ASSET_EXTENSIONS = [
    ".png", ".jpg", ".jpeg", ".gif", ".svg", ".ico", ".webp", ".woff", ".woff2", ".ttf", ".eot",
    ".mp3", ".mp4", ".wav", ".ogg", ".pdf", ".zip", ".tar", ".gz",
]
ENTRY_FOLDERS = ["cmd", "cli", "bin"]
API_FOLDERS = ["api", "routes", "handlers", "endpoints", "controllers"]
DATA_FOLDERS = ["models", "entities", "schema", "domain"]
MODULE_ROOTS = ["internal", "pkg", "lib", "src", "cmd", "app", "packages"]
#: Language of each extension.
LANGUAGES = {
    ".go": "Go", ".py": "Python", ".js": "JavaScript", ".ts": "TypeScript", ".tsx": "TypeScript", ".jsx": "JavaScript",
    ".rs": "Rust", ".java": "Java", ".rb": "Ruby", ".c": "C", ".cpp": "C++", ".cc": "C++", ".cxx": "C++",
    ".h": "C/C++ Header", ".hpp": "C/C++ Header", ".cs": "C#", ".swift": "Swift", ".kt": "Kotlin", ".kts": "Kotlin",
    ".scala": "Scala", ".sh": "Shell", ".bash": "Shell", ".zsh": "Shell", ".sql": "SQL", ".html": "HTML", ".htm": "HTML",
    ".css": "CSS", ".scss": "CSS", ".less": "CSS", ".yaml": "YAML", ".yml": "YAML", ".json": "JSON", ".xml": "XML",
    ".proto": "Protobuf", ".tf": "Terraform", ".md": "Markdown", ".toml": "TOML", ".lua": "Lua", ".r": "R", ".zig": "Zig",
    ".ex": "Elixir", ".exs": "Elixir", ".erl": "Erlang", ".hs": "Haskell", ".ml": "OCaml", ".mli": "OCaml",
    ".pl": "Perl", ".pm": "Perl", ".php": "PHP", ".dart": "Dart",
}
#: Extensions with a language that hold no program.
NOT_SOURCE = [".md", ".json", ".yaml", ".yml", ".xml", ".toml"]


def base_name(path: Column) -> Column:
    """Last part of a path."""
    return F.substring_index(path, "/", -1)


def dir_name(path: Column) -> Column:
    """Path without its last part; ``.`` if there is no folder."""
    return F.when(path.contains("/"), F.regexp_replace(path, r"/[^/]*$", "")).otherwise(F.lit("."))


def extension(path: Column) -> Column:
    """Lower-cased extension with its dot, or empty."""
    return F.lower(F.regexp_extract(base_name(path), r"(\.[^.]*)$", 1))


def language(path: Column) -> Column:
    """Programming language by extension, or empty."""
    table = F.create_map(*[F.lit(x) for pair in LANGUAGES.items() for x in pair])
    return F.coalesce(F.element_at(table, extension(path)), F.lit(""))


def is_test_file(path: Column) -> Column:
    """A test file by the scanner's rules."""
    base, ext = base_name(path), extension(path)
    script = ext.isin(".ts", ".tsx", ".js", ".jsx") & (base.contains(".spec.") | base.contains(".test."))
    stem = F.regexp_replace(base, r"\.py$", "")
    python = (ext == ".py") & (base.startswith("test_") | stem.endswith("_test"))
    return ((ext == ".go") & base.endswith("_test.go")) | script | python | ((ext == ".java") & F.lower(base).contains("test"))


def classify(path: Column) -> Column:
    """Role of a file; the first rule that holds decides."""
    base, ext, low = base_name(path), extension(path), F.lower(path)
    infra = (base == "Dockerfile") | base.startswith("Dockerfile.") | ext.isin(".tf", ".hcl") | base.isin("docker-compose.yml", "docker-compose.yaml") | low.rlike("kubernetes/|k8s/|helm/")
    roles = F.transform(
        F.split(low, "/"),
        lambda p: F.when(p.isin(ENTRY_FOLDERS), F.lit("entry_point")).when(p.isin(API_FOLDERS), F.lit("api")).when(p.isin(DATA_FOLDERS), F.lit("data_layer")),
    )
    by_folder = F.get(F.filter(roles, lambda r: r.isNotNull()), F.lit(0))
    return (
        F.when(is_test_file(path), F.lit("test"))
        .when(infra, F.lit("infra"))
        .when(base.isin(CONFIG_NAMES) | ext.isin(CONFIG_EXTENSIONS), F.lit("config"))
        .when(ext.isin(DOC_EXTENSIONS) | base.isin(DOC_NAMES), F.lit("doc"))
        .when(ext.isin(ASSET_EXTENSIONS), F.lit("asset"))
        .when(by_folder.isNotNull(), by_folder)
        .when((language(path) != "") & ~ext.isin(NOT_SOURCE), F.lit("source"))
        .otherwise(F.lit("unknown"))
    )


def detect_module(path: Column) -> Column:
    """First folder under the leftmost known root, else the first folder."""
    roots = "|".join(MODULE_ROOTS)
    known = F.regexp_extract(path, rf"(?:^|/)((?:{roots})/[^/]*)/", 1)
    return F.when(~path.contains("/"), F.lit("(root)")).when(known != "", known).otherwise(F.split_part(path, F.lit("/"), F.lit(1)))


def clean_path(path: Column) -> Column:
    """A path without white space around it, ``.``, ``..`` where it can be undone, doubled or leading slashes."""
    p = F.replace(F.trim(path), F.lit("\\"), F.lit("/"))
    none = F.array().cast("array<string>")

    def step(kept: Column, x: Column) -> Column:
        last = F.coalesce(F.element_at(F.concat(F.array(F.lit("..")), kept), -1), F.lit(".."))
        up = F.when(last != "..", F.slice(kept, F.lit(1), F.size(kept) - 1)).when(p.startswith("/"), kept).otherwise(F.concat(kept, F.array(x)))
        return F.when(x.isin("", "."), kept).when(x == "..", up).otherwise(F.concat(kept, F.array(x)))

    return F.array_join(F.aggregate(F.split(p, "/"), none, step), "/")


def glob_regex(glob: str) -> str:
    """A glob as a regex; ``*`` and ``?`` do not cross ``/``."""
    out, i = "", 0
    while i < len(glob):
        c = glob[i]
        if c == "[" and (j := glob.find("]", i + 1)) > 0:
            out += "[" + glob[i + 1 : j].replace("\\", "\\\\") + "]"
            i = j
        else:
            out += {"*": "[^/]*", "?": "[^/]"}.get(c, re.escape(c))
        i += 1
    return f"^{out}$"


def excluded(path: Column, globs: list[str]) -> Column:
    """Whether a glob matches the whole path or its last part."""
    hit = F.lit(False)
    for g in globs:
        hit = hit | path.rlike(glob_regex(g)) | base_name(path).rlike(glob_regex(g))
    return hit


def is_session_test_file(path: Column) -> Column:
    """A test file by the workflow detector's rules, which differ from the scanner's."""
    base = base_name(path)
    return base.contains("_test.") | base.startswith("test_") | F.exists(F.split(dir_name(path), "/"), lambda p: p.isin("test", "tests", "testdata"))


#: Branch prefixes, workflow and confidence, in order.
BRANCH_RULES = [
    (["fix/", "bug/", "bugfix/", "hotfix/"], "bugfix", 0.9),
    (["feat/", "feature/", "add-"], "feature", 0.9),
    (["refactor/", "cleanup/", "chore/"], "refactor", 0.9),
    (["test/", "testing/", "tests/"], "test", 0.85),
]


def detect_workflow(branch: Column, changed: Column, session: Column, uncommitted: Column, main: Column) -> Column:
    """``struct<workflow, confidence>`` by ordered rules."""
    name = F.lower(F.trim(F.coalesce(branch, F.lit(""))))
    row = lambda w, c: F.struct(F.lit(w).alias("workflow"), F.lit(c).alias("confidence"))
    out = None
    for prefixes, workflow, sure in BRANCH_RULES:
        hit = F.lit(False)
        for p in prefixes:
            hit = hit | name.startswith(p)
        out = F.when(hit, row(workflow, sure)) if out is None else out.when(hit, row(workflow, sure))
    n = F.coalesce(F.size(changed), F.lit(0))
    tests = F.size(F.filter(changed, is_session_test_file))
    return (
        out.when((n > 0) & (tests / n > 0.8), row("test", 0.8))
        .when((n <= 0) & (F.coalesce(F.size(session), F.lit(0)) >= 3), row("review", 0.7))
        .when(main & ~uncommitted, row("explore", 0.6))
        .otherwise(row("explore", 0.3))
    )
