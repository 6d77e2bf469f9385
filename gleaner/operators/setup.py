"""What a project is, told from the names of its files and a few manifests: stacks, purpose, entry points, gaps, questions.

All rules work on files (project, path, text) and give one row per project, or a few; repeated paths count once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gleaner.functions.text import basename, first_prose_line

#: Names of languages by file ending.
LANGUAGES = {
    "rs": "Rust", "js": "JavaScript", "mjs": "JavaScript", "cjs": "JavaScript", "ts": "TypeScript", "tsx": "TypeScript", "jsx": "JavaScript (JSX)", "py": "Python", "go": "Go", "java": "Java",
    "rb": "Ruby", "php": "PHP", "c": "C", "h": "C", "cpp": "C++", "cc": "C++", "cxx": "C++", "hpp": "C++", "cs": "C#", "swift": "Swift", "kt": "Kotlin", "kts": "Kotlin", "sh": "Shell", "bash": "Shell", "md": "Markdown",
}
#: Stacks in order, with the manifests that tell them (the first there is named) and their build, test and lint commands.
STACKS = (
    ("Node.js", ("package.json",), None, None, None),
    ("Rust", ("Cargo.toml",), "cargo build --release", "cargo test", "cargo clippy && cargo fmt --check"),
    ("Go", ("go.mod",), "go build ./...", "go test ./...", "go vet ./..."),
    ("Python", ("pyproject.toml", "setup.py", "requirements.txt"), None, "pytest", "ruff check . || flake8"),
    ("Java (Maven)", ("pom.xml",), "mvn -q compile", "mvn -q test", None),
    ("Java/Kotlin (Gradle)", ("build.gradle", "build.gradle.kts"), "./gradlew build", "./gradlew test", None),
    ("Make", ("Makefile",), "make", "make test", None),
)
#: Entry points in order.
ENTRY_POINTS = "src/main.rs src/lib.rs main.go cmd/main.go src/index.ts src/index.js index.ts index.js src/main.py main.py app.py src/App.tsx src/app.tsx".split()
#: What is missing, in order, by the signal that tells it is there.
GAPS = {
    "readme": "Add a README.md stating the project's purpose, setup, and usage.", "tests": "Add a test suite — no test files detected.",
    "ci": "Add CI (e.g. .github/workflows) to build, test, and lint on push.", "lint_config": "Add linter/formatter config so style is enforced consistently.",
    "license": "Add a LICENSE so the terms of use are explicit.", "gitignore": "Add a .gitignore so build artifacts never pollute the repo.",
    "editorconfig": "Consider an .editorconfig for consistent whitespace across editors.", "docs": "Consider a docs/ directory once the public surface stabilizes.",
}
#: Questions, with the signal whose absence asks them (None: always).
QUESTIONS = (
    ("purpose", "What is the primary goal of this project, in one sentence?"),
    ("purpose", "Who is the intended user, and what is the single most important thing it must do well?"),
    (None, 'What does "done" look like — the concrete acceptance criteria for this project?'),
    ("tests", "What is the testing strategy and the expected level of coverage?"),
    (None, "Are there constraints (deadline, platforms, dependencies, performance) I must respect?"),
)
READMES = ("README.md", "README", "readme.md")


def is_test_path(path: Column) -> Column:
    """The report's own notion of a test file. Fixed values."""
    p = F.lower(path)
    hit = F.contains(p, F.lit("/test")) | p.startswith("test") | F.contains(p, F.lit("test_")) | F.contains(p, F.lit("__tests__/"))
    for end in ("_test.go", ".test.ts", ".test.js", ".spec.ts", ".spec.js", "_test.py"):
        hit = hit | p.endswith(end)
    return hit


def is_lint_config(path: Column) -> Column:
    """Fixed values."""
    b = basename(path)
    return b.startswith(".eslintrc") | b.startswith(".prettierrc") | b.isin("rustfmt.toml", ".rustfmt.toml", "clippy.toml", ".flake8", "ruff.toml", ".ruff.toml", ".golangci.yml", ".golangci.yaml", "biome.json")


def _once(files: DataFrame) -> DataFrame:
    return files.where("path is not null").groupBy("project", "path").agg(F.max("text").alias("text"))


def language_counts(files: DataFrame) -> DataFrame:
    """(project, rank, language, n): languages by the number of files, most first, ties by name."""
    from pyspark.sql import Window

    names = F.create_map(*[F.lit(x) for kv in LANGUAGES.items() for x in kv])
    n = _once(files).select("project", F.try_element_at(names, F.lower(F.regexp_extract("path", r"\.([^./]+)$", 1))).alias("language")).where("language is not null").groupBy("project", "language").agg(F.count(F.lit(1)).alias("n"))
    return n.withColumn("rank", F.row_number().over(Window.partitionBy("project").orderBy(F.desc("n"), "language"))).select("project", "rank", "language", "n")


def signals(files: DataFrame) -> DataFrame:
    """One row per project: what is there, the manifests, entry points and top folders that exist, and its purpose.

    The purpose is the description in package.json, else the first prose line of the read-me, in the order of its names.
    """
    f = _once(files)
    p = F.col("path")
    there = lambda *names: F.max(p.isin(*names))
    manifests = [m for s in STACKS for m in s[1]]
    text_of = lambda name: F.max(F.when(p == name, F.col("text")))
    g = f.groupBy("project").agg(
        F.count(F.lit(1)).alias("files"), there(*READMES).alias("readme"), F.max(is_test_path(p)).alias("tests"), (F.max(p.startswith(".github/workflows/")) | there(".gitlab-ci.yml", ".circleci/config.yml")).alias("ci"),
        there("LICENSE", "LICENSE.md", "LICENSE.txt").alias("license"), there(".gitignore").alias("gitignore"), F.max(is_lint_config(p)).alias("lint_config"), F.max(p.startswith("docs/") | p.startswith("doc/")).alias("docs"), there(".editorconfig").alias("editorconfig"),
        F.collect_set(F.when(p.isin(*manifests), p)).alias("manifests"), F.collect_set(F.when(p.isin(*ENTRY_POINTS), p)).alias("entries"), F.array_sort(F.collect_set(F.when(F.contains(p, F.lit("/")), F.split_part(p, F.lit("/"), F.lit(1))))).alias("top_folders"),
        text_of("package.json").alias("package"), F.coalesce(*[first_prose_line(text_of(n)) for n in READMES]).alias("prose"),
    )
    said = F.trim(F.try_variant_get(F.try_parse_json("package"), "$.description", "string"))
    return g.withColumn("purpose", F.coalesce(F.when(said != "", said), "prose")).drop("prose")


def stacks(found: DataFrame) -> DataFrame:
    """(project, pos, stack, manifest, build, test, lint) of ``signals``; a Makefile counts only where nothing else does.

    Commands of Node.js come from the scripts of package.json.
    """
    have = lambda names: F.coalesce(*[F.when(F.array_contains("manifests", n), n) for n in names])
    j = F.try_parse_json("package")
    scripted = lambda k: F.when(F.try_variant_get(j, f"$.scripts.{k}", "string").isNotNull(), f"npm run {k}")
    parts = []
    for pos, (name, manifests, *commands) in enumerate(STACKS):
        build, test, lint = (scripted(k) for k in ("build", "test", "lint")) if name == "Node.js" else (F.lit(c).cast("string") for c in commands)
        shown = F.lit(manifests[0]) if name.endswith("(Gradle)") else have(manifests)
        parts.append(F.when(have(manifests).isNotNull(), F.struct(F.lit(pos).alias("pos"), F.lit(name).alias("stack"), shown.alias("manifest"), build.alias("build"), test.alias("test"), lint.alias("lint"))))
    real = F.filter(F.array(*parts), lambda x: x.isNotNull())
    real = F.filter(real, lambda x: (x["stack"] != "Make") | (F.size(real) == 1))
    return found.select("project", F.explode(real).alias("s")).select("project", "s.*")


def entry_points(found: DataFrame, most: int = 5) -> DataFrame:
    """(project, entry_points): those that exist, in order, at most five."""
    return found.select("project", F.slice(F.filter(F.array(*map(F.lit, ENTRY_POINTS)), lambda e: F.array_contains("entries", e)), 1, most).alias("entry_points"))


def gaps(found: DataFrame) -> DataFrame:
    """(project, gaps, questions): what is missing, in order; missing lint settings count only where there is a stack."""
    missing = [F.when(~F.coalesce(F.col(k), F.lit(False)) & (F.lit(True) if k != "lint_config" else F.size("manifests") > 0), text) for k, text in GAPS.items()]
    absent = {"purpose": F.col("purpose").isNull(), "tests": ~F.coalesce(F.col("tests"), F.lit(False)), None: F.lit(True)}
    asked = [F.when(absent[k], text) for k, text in QUESTIONS]
    full = lambda items: F.filter(F.array(*items), lambda x: x.isNotNull())
    return found.select("project", full(missing).alias("gaps"), full(asked).alias("questions"))


def report(files: DataFrame) -> DataFrame:
    """One row per project with everything above, lists in their order."""
    found = signals(files)
    s = stacks(found).groupBy("project").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "stack", "manifest", "build", "test", "lint"))), lambda x: F.concat_ws(" | ", x["stack"], x["manifest"], x["build"], x["test"], x["lint"])).alias("stacks"))
    langs = language_counts(files).groupBy("project").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "language", "n"))), lambda x: F.concat(x["language"], F.lit(" "), x["n"])).alias("languages"))
    return found.select("project", "files", "purpose", "top_folders").join(s, "project", "left").join(langs, "project", "left").join(entry_points(found), "project").join(gaps(found), "project")


def project_type(found: DataFrame, rules: list[tuple[str, str]], default: str = "unknown") -> DataFrame:
    """(project, type): the label of the first rule (manifest, label) whose manifest the project has."""
    label = F.coalesce(*[F.when(F.array_contains("manifests", m), t) for m, t in rules], F.lit(default))
    return found.select("project", label.alias("type"))
