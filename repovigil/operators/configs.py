"""Framework filter settings: what to keep and what to drop for each web framework."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from repovigil.functions.tables import constant_table

FRAMEWORKS = ["express", "fastify", "nestjs", "springboot", "flask", "django", "nextjs", "unknown"]

# ---------------------------------------------------------------------------------------------
# Extension, name and directory lists that define the filter results.
# ---------------------------------------------------------------------------------------------
BASE_EXTENSIONS = [
    ".md", ".mdx", ".txt", ".rst", ".json", ".yaml", ".yml", ".toml", ".xml", ".env", ".env.example",
    ".env.local", ".sh", ".bash", ".dockerfile", ".sql", ".graphql", ".gql",
]
BASE_SPECIAL_FILES = [
    "dockerfile", "makefile", ".gitignore", ".dockerignore", ".editorconfig", ".nvmrc", ".node-version",
    ".python-version", "procfile",
]
BASE_IGNORE_DIRS = [
    "node_modules", ".git", ".svn", ".hg", ".idea", ".vscode", ".vs", "__pycache__", ".pytest_cache",
    ".mypy_cache", ".tox", ".nox", ".venv", "venv", "env", ".env", "virtualenv", "dist", "build", "out",
    "target", ".next", ".nuxt", ".output", "coverage", ".nyc_output", "logs", "tmp", "temp", ".tmp",
    ".temp", ".cache", ".gradle", ".m2", "bin", "obj",
]
BASE_IGNORE_FILES = [
    "package-lock.json", "pnpm-lock.yaml", "yarn.lock", "poetry.lock", "pipfile.lock", "composer.lock",
    "gemfile.lock", "cargo.lock", "*.min.js", "*.min.css", "*.bundle.js", "*.chunk.js", "*.map", "*.js.map",
    "*.css.map", ".ds_store", "thumbs.db", "desktop.ini", "*.iml", ".project", ".classpath", "*.pyc",
    "*.pyo", "*.class", "*.o", "*.obj", "*.dll", "*.exe", "*.so", "*.dylib",
]
# Directories skipped before a file is read at all (unanchored substrings).
QUICK_IGNORE = [
    "node_modules/", ".git/", "__pycache__/", ".venv/", "venv/", "dist/", "build/", "target/", ".next/",
    ".gradle/",
]
EXTRA_EXTENSIONS = {
    "express": [".js", ".mjs", ".cjs", ".ts", ".mts", ".cts", ".jsx", ".tsx", ".html", ".htm", ".css", ".scss",
                ".sass", ".less", ".ejs", ".pug", ".hbs", ".handlebars", ".prisma"],
    "fastify": [".js", ".mjs", ".cjs", ".ts", ".mts", ".cts", ".jsx", ".tsx", ".html", ".htm", ".css", ".scss",
                ".sass", ".less", ".prisma"],
    "nestjs": [".ts", ".mts", ".cts", ".js", ".mjs", ".cjs", ".html", ".htm", ".css", ".scss", ".sass", ".less",
               ".prisma"],
    "springboot": [".java", ".kt", ".kts", ".scala", ".groovy", ".properties", ".html", ".htm", ".css", ".scss",
                   ".js", ".ts", ".ftl", ".ftlh", ".thymeleaf"],
    "flask": [".py", ".pyw", ".pyi", ".html", ".htm", ".css", ".scss", ".sass", ".less", ".js", ".ts", ".jinja",
              ".jinja2", ".j2", ".cfg", ".ini"],
    "django": [".py", ".pyw", ".pyi", ".html", ".htm", ".css", ".scss", ".sass", ".less", ".js", ".ts", ".jinja",
               ".jinja2", ".j2", ".cfg", ".ini"],
    "nextjs": [".js", ".mjs", ".cjs", ".ts", ".mts", ".cts", ".jsx", ".tsx", ".html", ".htm", ".css", ".scss",
               ".sass", ".less", ".module.css", ".module.scss", ".prisma", ".vue", ".svelte", ".astro"],
    "unknown": [".js", ".jsx", ".ts", ".tsx", ".mjs", ".cjs", ".py", ".pyw", ".java", ".kt", ".scala", ".groovy",
                ".c", ".cpp", ".cc", ".h", ".hpp", ".cs", ".go", ".rs", ".rb", ".php", ".swift", ".html", ".htm",
                ".css", ".scss", ".sass", ".less", ".vue", ".svelte", ".astro", ".ejs", ".pug", ".hbs", ".jinja",
                ".jinja2", ".prisma", ".tf", ".tfvars"],
}
EXTRA_SPECIAL_FILES = {
    "springboot": ["gradlew", "mvnw"],
    "flask": ["requirements.txt", "setup.py", "setup.cfg", "pyproject.toml", "pipfile", "wsgi.py", "asgi.py"],
    "django": ["requirements.txt", "setup.py", "setup.cfg", "pyproject.toml", "pipfile", "manage.py", "wsgi.py",
               "asgi.py"],
}
EXTRA_IGNORE_DIRS = {
    "express": ["public/uploads", "uploads"],
    "springboot": [".gradle", ".m2", "target", "build", ".mvn/wrapper", ".gradle/wrapper"],
    "flask": ["__pycache__", ".pytest_cache", ".mypy_cache", "*.egg-info", ".eggs", "instance"],
    "django": ["__pycache__", ".pytest_cache", ".mypy_cache", "*.egg-info", ".eggs", "staticfiles", "media",
               "migrations"],
    "nextjs": [".next", ".vercel", ".turbo", "public"],
}
EXTRA_IGNORE_FILES = {
    "springboot": ["gradlew.bat", "mvnw.cmd", "*.jar", "*.war"],
    "flask": ["*.pyc", "*.pyo", "*.pyd", "*.egg"],
    "django": ["*.pyc", "*.pyo", "*.pyd", "*.egg", "*.sqlite3", "db.sqlite3"],
}
IMPORTANT_FILES = {
    "express": ["package.json", "app.js", "app.ts", "server.js", "server.ts", "index.js", "index.ts",
                "tsconfig.json", ".eslintrc", ".eslintrc.js", ".eslintrc.json"],
    "fastify": ["package.json", "app.js", "app.ts", "server.js", "server.ts", "index.js", "index.ts",
                "tsconfig.json", "fastify.config.js"],
    "nestjs": ["package.json", "nest-cli.json", "tsconfig.json", "tsconfig.build.json", "main.ts",
               "app.module.ts"],
    "springboot": ["pom.xml", "build.gradle", "build.gradle.kts", "settings.gradle", "settings.gradle.kts",
                   "application.properties", "application.yml", "application.yaml", "application-*.properties",
                   "application-*.yml"],
    "flask": ["app.py", "application.py", "wsgi.py", "config.py", "requirements.txt", "pyproject.toml",
              "setup.py"],
    "django": ["manage.py", "settings.py", "urls.py", "wsgi.py", "asgi.py", "requirements.txt",
               "pyproject.toml"],
    "nextjs": ["package.json", "next.config.js", "next.config.mjs", "next.config.ts", "tsconfig.json",
               "tailwind.config.js", "tailwind.config.ts", "postcss.config.js", "postcss.config.mjs"],
}
# ---------------------------------------------------------------------------------------------

CONFIG_COLUMNS = ["framework", "extensions", "special_files", "ignore_dirs", "ignore_files", "important_files"]


def _merged(base: list[str], extra: list[str]) -> list[str]:
    return list(dict.fromkeys(base + extra))


def config_rows() -> list[tuple]:
    return [
        (
            fw,
            _merged(BASE_EXTENSIONS, EXTRA_EXTENSIONS[fw]),
            BASE_SPECIAL_FILES + EXTRA_SPECIAL_FILES.get(fw, []),
            BASE_IGNORE_DIRS + EXTRA_IGNORE_DIRS.get(fw, []),
            BASE_IGNORE_FILES + EXTRA_IGNORE_FILES.get(fw, []),
            IMPORTANT_FILES.get(fw, []),
        )
        for fw in FRAMEWORKS
    ]


def framework_config(spark: SparkSession) -> DataFrame:
    """The settings as an 8-row dimension; its size is fixed, so it may always be broadcast."""
    return constant_table(spark, CONFIG_COLUMNS, config_rows())
