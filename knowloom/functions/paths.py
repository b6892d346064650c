"""Path expressions: names, stems, suffixes, parents, classification."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from .text import col

# The name and suffix lists that decide classification.
DOC_SUFFIXES = (".md", ".markdown", ".rst", ".txt")
DOC_NAME_PREFIXES = ("README", "CONTRIBUTING", "CHANGELOG", "LICENSE", "ARCHITECTURE", "SECURITY")
DOC_FOLDERS = ("docs", "doc", "documentation")
CODE_SUFFIXES = (
    ".py", ".js", ".ts", ".jsx", ".tsx", ".go", ".java", ".c", ".cpp",
    ".rs", ".rb", ".cs", ".php", ".sh", ".yaml", ".yml", ".json",
)
WALK_SKIP_SUFFIXES = (
    ".png", ".jpg", ".jpeg", ".gif", ".svg", ".ico", ".woff", ".woff2",
    ".ttf", ".eot", ".zip", ".tar", ".gz", ".exe", ".dll", ".so", ".dylib",
    ".pyc", ".db", ".sqlite", ".lock", ".bin", ".pdf",
)
WALK_SKIP_FOLDERS = (
    ".git", "node_modules", "__pycache__", ".venv", "venv", "dist",
    "build", ".pytest_cache", ".idea", ".vscode", ".next", "out", "tmp_repos",
    "chroma_db", "chroma", ".chroma",
)
INVENTORY_SKIP_FOLDERS = (
    ".git", ".hg", ".svn", ".idea", ".vscode", ".next", ".nuxt", ".cache",
    "node_modules", "vendor", "dist", "build", "out", "target", ".gradle",
    ".venv", "venv", "env", "__pycache__", ".pytest_cache", ".mypy_cache",
    "coverage", "htmlcov", "bin", "obj",
)
SENSITIVE_NAMES = (
    ".env", ".npmrc", ".pypirc", "credentials", "credentials.json", "secrets.json",
    "id_rsa", "id_dsa", "id_ecdsa", "id_ed25519", "service-account.json",
)
MANIFEST_NAMES = (
    "package.json", "pyproject.toml", "requirements.txt", "poetry.lock", "pipfile",
    "pom.xml", "build.gradle", "build.gradle.kts", "settings.gradle", "go.mod",
    "cargo.toml", "composer.json", "gemfile", "mix.exs", "pubspec.yaml",
)
DEPLOYMENT_NAMES = (
    "dockerfile", "docker-compose.yml", "docker-compose.yaml", "compose.yml",
    "compose.yaml", "helmfile.yaml", "procfile", "vercel.json", "netlify.toml",
)
LANGUAGE_BY_SUFFIX = {
    ".py": "Python", ".pyi": "Python", ".js": "JavaScript", ".jsx": "JavaScript",
    ".ts": "TypeScript", ".tsx": "TypeScript", ".java": "Java", ".kt": "Kotlin",
    ".kts": "Kotlin", ".go": "Go", ".rs": "Rust", ".cs": "C#", ".fs": "F#",
    ".php": "PHP", ".rb": "Ruby", ".scala": "Scala", ".c": "C", ".h": "C/C++",
    ".cpp": "C++", ".cc": "C++", ".hpp": "C++", ".swift": "Swift",
    ".dart": "Dart", ".vue": "Vue", ".svelte": "Svelte", ".sql": "SQL",
    ".sh": "Shell", ".ps1": "PowerShell",
}
OTHER_TEXT_SUFFIXES = (
    ".md", ".mdx", ".rst", ".txt", ".json", ".jsonc", ".yaml", ".yml", ".toml",
    ".ini", ".cfg", ".conf", ".xml", ".properties", ".gradle", ".html", ".css",
    ".scss", ".less", ".graphql", ".gql", ".proto", ".env", ".example",
)
CONFIG_SUFFIXES = (
    ".json", ".jsonc", ".yaml", ".yml", ".toml", ".ini", ".cfg", ".conf", ".xml", ".properties",
)
FRAMEWORK_MARKERS = {
    "FastAPI": ("fastapi",), "Django": ("django",), "Flask": ("flask",),
    "React": ('"react"', "'react'"), "Next.js": ("next",), "Vue": ('"vue"',),
    "Angular": ("@angular/core",), "Express": ("express",), "NestJS": ("@nestjs/core",),
    "Spring Boot": ("spring-boot",), "Hibernate": ("hibernate",),
    ".NET": ("microsoft.net.sdk",), "Laravel": ("laravel/framework",),
    "Ruby on Rails": ("rails",),
}
COMPONENT_GROUP_FOLDERS = ("apps", "packages", "services")
COMPONENT_TOP_FOLDERS = ("backend", "frontend", "server", "client", "api", "web")


def name(path) -> Column:
    return F.substring_index(col(path), "/", -1)


def parent(path) -> Column:
    """Folder of a path, empty at the root."""
    return F.regexp_replace(F.regexp_replace(col(path), r"[^/]*$", ""), r"/$", "")


def suffix(path) -> Column:
    """Last dotted part of the name; dot files have none."""
    return F.regexp_extract(name(path), r"^.+(\.[^.]+)$", 1)


def stem(path) -> Column:
    return F.regexp_replace(name(path), r"^(.+)\.[^.]+$", "$1")


def parts(path) -> Column:
    return F.split(col(path), "/")


def module_of(path) -> Column:
    """First path segment, or ``_root`` for files at the top."""
    return F.when(F.instr(col(path), "/") == 0, F.lit("_root")).otherwise(F.substring_index(col(path), "/", 1))


def is_document(path) -> Column:
    base = F.upper(name(path))
    by_name = F.lit(False)
    for prefix in DOC_NAME_PREFIXES:
        by_name = by_name | base.startswith(prefix)
    by_folder = F.arrays_overlap(parts(F.lower(col(path))), F.array(*map(F.lit, DOC_FOLDERS)))
    return F.lower(suffix(path)).isin(*DOC_SUFFIXES) | by_name | by_folder


def is_sensitive(path) -> Column:
    base = F.lower(name(path))
    return base.isin(*SENSITIVE_NAMES) | base.rlike(r"^\.env\.|\.(pem|key|p12|pfx)$")


def language(path) -> Column:
    pairs = [F.lit(x) for kv in LANGUAGE_BY_SUFFIX.items() for x in kv]
    return F.try_element_at(F.create_map(*pairs), F.lower(suffix(path)))


def category(path) -> Column:
    """Ordered file classification of the source inventory."""
    low = F.lower(col(path))
    base, ext, folders = name(low), suffix(low), parts(low)

    def inside(*names):
        return F.arrays_overlap(folders, F.array(*map(F.lit, names)))

    return (
        F.when(base.isin(*MANIFEST_NAMES) | base.rlike(r"\.(csproj|fsproj|sln)$"), "manifest")
        .when(base.isin(*DEPLOYMENT_NAMES) | inside("k8s", "kubernetes", "helm"), "deployment")
        .when(inside("migration", "migrations"), "migration")
        .when(inside("test", "tests", "spec") | base.rlike(r"(^|[._-])(test|spec)([._-]|$)"), "test")
        .when(ext.isin(".md", ".mdx", ".rst", ".txt") | inside("docs", "documentation"), "documentation")
        .when(ext.isin(*LANGUAGE_BY_SUFFIX), "source")
        .when(ext.isin(*CONFIG_SUFFIXES), "configuration")
        .otherwise("other_text")
    )


def is_recognized_text(path) -> Column:
    base = F.lower(name(path))
    return (
        F.lower(suffix(path)).isin(*LANGUAGE_BY_SUFFIX, *OTHER_TEXT_SUFFIXES)
        | base.isin(*MANIFEST_NAMES, *DEPLOYMENT_NAMES, "makefile", "gemfile")
    )


def frameworks(manifest_text) -> Column:
    """Sorted names of the frameworks whose markers occur in a manifest."""
    low = F.lower(col(manifest_text))
    hits = []
    for label, markers in FRAMEWORK_MARKERS.items():
        found = F.lit(False)
        for marker in markers:
            found = found | low.contains(marker)
        hits.append(F.when(found, F.lit(label)))
    return F.array_sort(F.array_compact(F.array(*hits)))


def component(path) -> Column:
    """Monorepo-aware component: one or two leading folders."""
    p = parts(path)
    depth = F.size(p) - 1
    head = F.element_at(p, 1)
    two = F.array_join(F.slice(p, 1, 2), "/")
    return (
        F.when(depth == 0, F.lit("_root"))
        .when(head.isin(*COMPONENT_GROUP_FOLDERS) & (depth > 1), two)
        .when(head.isin(*COMPONENT_TOP_FOLDERS), head)
        .when((head == "src") & (depth > 1), two)
        .otherwise(head)
    )


def is_test_path(path) -> Column:
    low = F.lower(col(path))
    base = name(low)
    return (
        F.arrays_overlap(parts(low), F.array(*map(F.lit, ("tests", "test", "__tests__"))))
        | base.startswith("test_")
        | base.endswith("_test.py")
        | base.contains(".test.")
        | base.contains(".spec.")
    )


def tested_stem(path) -> Column:
    """Stem of the file a test is about: affixes and .test/.spec parts removed."""
    s = stem(path)
    bare = F.when(s.startswith("test_"), F.substr(s, F.lit(6))).when(
        s.endswith("_test"), F.regexp_replace(s, "_test$", "")
    ).otherwise(s)
    return F.replace(F.replace(bare, F.lit(".test"), F.lit("")), F.lit(".spec"), F.lit(""))


def repository_name(url) -> Column:
    """Lower-cased last path stem of an scp-style address, URL or local path."""
    clean = F.trim(col(url))
    path = (
        F.when(clean.startswith("git@") & clean.contains(":"), F.regexp_replace(clean, r"^[^:]*:", ""))
        .when(clean.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*://"), F.regexp_replace(F.regexp_replace(clean, r"[?#].*$", ""), r"^[^:]+://[^/]*", ""))
        .otherwise(F.regexp_replace(clean, r"[?#].*$", ""))
    )
    last = F.lower(stem(F.regexp_replace(path, r"/+$", "")))
    host = F.lower(stem(clean))
    return F.coalesce(F.nullif(last, F.lit("")), F.nullif(host, F.lit("")), F.lit("repo"))


def repository_url_problem(url) -> Column:
    """Why a repository address is refused for ingestion; null when it is fine."""
    u = F.trim(col(url))
    remote = u.rlike("^(https?|git)://")
    return (
        F.when(u == "", "empty")
        .when(u.rlike("^(file|ftp|ftps)://"), "unsupported_scheme")
        .when(remote & ~u.rlike("^[a-z]+://[^/?#]+"), "invalid_format")
        .when(remote | (u.startswith("git@") & u.contains(":")), F.lit(None))
        .when(F.array_contains(parts(u), ".."), "path_traversal")
        .when(~u.startswith("/"), "relative_path")
    )


def remote_url_problem(url, allowed_hosts: tuple[str, ...] = ()) -> Column:
    """Why an address is refused for source analysis (credential-free HTTPS only); null when fine."""
    u = F.trim(col(url))
    authority = F.regexp_extract(u, r"^https://([^/?#]*)", 1)
    host = F.lower(F.regexp_replace(F.regexp_replace(authority, r"^.*@", ""), r":\d*$", ""))
    problem = (
        F.when((authority == "") | (host == ""), "not_https")
        .when(authority.contains("@"), "credentials")
        .when(u.rlike(r"[?#]"), "query_or_fragment")
    )
    if allowed_hosts:
        problem = F.coalesce(problem, F.when(~host.isin(*[h.strip().lower() for h in allowed_hosts]), "host_not_enabled"))
    return problem


def git_ref_ok(ref) -> Column:
    """Whether a branch, tag or commit name is well formed; a blank one means the default."""
    r = F.trim(F.coalesce(col(ref), F.lit("")))
    return (r == "") | (
        r.rlike(r"^[A-Za-z0-9][A-Za-z0-9._/-]{0,254}\z") & ~r.contains("..") & ~r.rlike(r"(/|\.|\.lock)\z")
    )
