"""Results depend on these exact lists, scores, patterns and texts."""

# Directories that are never read (the last but two is this tool's own).
IGNORED_DIRS = [
    ".git", ".hg", ".svn", "node_modules", "venv", ".venv", "env", "dist", "build", "coverage", ".next", ".vinext", "__pycache__",
    "vendor", ".tox", ".mypy_cache", ".pytest_cache", ".ruff_cache", ".idea", ".vscode", ".codestrata", ".turbo", ".cache",
]

# Suffixes and names of files that are read.
SUFFIXES = [
    ".py", ".pyi", ".js", ".jsx", ".mjs", ".cjs", ".ts", ".tsx", ".json", ".toml", ".yaml", ".yml", ".ini", ".cfg", ".sql", ".prisma",
    ".md", ".mdx", ".html", ".css", ".scss", ".dockerfile", ".sh", ".bash", ".graphql", ".gql",
]
SPECIAL_NAMES = [
    "Dockerfile", "Procfile", "Makefile", "Pipfile", "package.json", "requirements.txt", "pyproject.toml", "poetry.lock", "Pipfile.lock",
    "docker-compose.yml", "docker-compose.yaml", "compose.yml", "compose.yaml", "go.mod", "Cargo.toml", "pom.xml", "build.gradle",
    "tsconfig.json", "jsconfig.json",
]

# Size limits (files, bytes of a file, bytes of an archive, bytes of all extracted files).
MAX_FILES, MAX_FILE_BYTES, MAX_ARCHIVE_BYTES, MAX_EXTRACTED_BYTES = 10_000, 1_000_000, 100_000_000, 100 * 1024 * 1024

# Language of a suffix; all others are Configuration.
LANGUAGES = {
    ".py": "Python", ".pyi": "Python", ".js": "JavaScript", ".jsx": "JavaScript", ".mjs": "JavaScript", ".cjs": "JavaScript",
    ".ts": "TypeScript", ".tsx": "TypeScript", ".sql": "SQL", ".prisma": "Prisma", ".html": "HTML", ".css": "CSS", ".scss": "SCSS",
    ".json": "Configuration", ".toml": "Configuration", ".yaml": "Configuration", ".yml": "Configuration", ".md": "Markdown",
    ".mdx": "Markdown", ".graphql": "GraphQL", ".gql": "GraphQL", ".sh": "Shell", ".bash": "Shell", ".zsh": "Shell",
}

# Components in order, their names, and the confidence of those that are 0.94 instead of 0.82.
COMPONENTS = [
    ("frontend", "Frontend"), ("api", "API layer"), ("services", "Services"), ("domain", "Domain"), ("repositories", "Repositories"),
    ("database", "Database"), ("workers", "Background workers"), ("infrastructure", "Infrastructure"), ("configuration", "Configuration"),
    ("tests", "Tests"), ("other", "Application core"),
]
SURE_COMPONENTS = ["api", "database", "tests"]

# Layer vocabulary, in the order of the rules, with the evidence text of each.
TEST_DIRS = ["tests", "test"]
TEST_ENDINGS = [".test.ts", ".test.tsx", ".spec.ts", ".spec.tsx", "_test.py", "test.py"]
LAYERS = [
    ("api", ["api", "routes", "routers", "controllers", "endpoints"], "contains or groups request handlers"),
    ("services", ["services", "service", "usecases", "use_cases"], "service or use-case path"),
    ("repositories", ["repositories", "repository", "dao"], "repository or DAO path"),
    ("database", ["models", "database", "db", "migrations", "schema", "entities"], "database path or ORM model evidence"),
    ("workers", ["workers", "worker", "jobs", "tasks", "queues"], "worker, job, or queue path"),
    ("frontend", ["frontend", "client", "components", "pages", "views", "ui"], "frontend path or component symbols"),
    ("domain", ["domain", "core"], "domain or core path"),
    ("infrastructure", ["infra", "infrastructure", ".github", "deploy"], "infrastructure manifest or path"),
]
INFRASTRUCTURE_NAMES = ["Dockerfile", "docker-compose.yml", "compose.yml"]
CONFIGURATION_SUFFIXES = [".json", ".toml", ".yaml", ".yml", ".ini", ".cfg"]

# Scores of conventional entry file names; each piece of evidence adds 35.
ENTRY_NAMES = {
    "main.py": 30, "__main__.py": 35, "app.py": 24, "server.py": 25, "wsgi.py": 20, "asgi.py": 22, "index.js": 22, "index.ts": 22,
    "server.js": 28, "server.ts": 28, "main.js": 24, "main.ts": 24, "main.tsx": 26,
}
ENTRY_EVIDENCE = 35
IMPORTANT_CONFIGURATION = ["package.json", "pyproject.toml", "Dockerfile", "tsconfig.json"]

# Steps of the tour by component.
TOUR = {
    "api": "Requests enter the application through these handlers.",
    "services": "Business behavior is coordinated in this layer.",
    "domain": "Core concepts and rules live here.",
    "repositories": "Persistence access is isolated here.",
    "database": "Models, schema, and database wiring live here.",
    "workers": "Asynchronous and long-running work begins here.",
}

# Technologies by JavaScript package.
PACKAGE_TECH = {
    "react": ("framework", "React"), "next": ("framework", "Next.js"), "express": ("framework", "Express"),
    "@nestjs/core": ("framework", "NestJS"), "vue": ("framework", "Vue"), "nuxt": ("framework", "Nuxt"), "svelte": ("framework", "Svelte"),
    "@sveltejs/kit": ("framework", "SvelteKit"), "astro": ("framework", "Astro"), "remix": ("framework", "Remix"),
    "@remix-run/react": ("framework", "Remix"), "solid-js": ("framework", "SolidJS"), "hono": ("framework", "Hono"),
    "fastify": ("framework", "Fastify"), "koa": ("framework", "Koa"), "@trpc/server": ("framework", "tRPC"),
    "gatsby": ("framework", "Gatsby"), "electron": ("framework", "Electron"), "vite": ("build", "Vite"), "webpack": ("build", "Webpack"),
    "rollup": ("build", "Rollup"), "esbuild": ("build", "esbuild"), "turbo": ("build", "Turborepo"),
    "tailwindcss": ("tooling", "Tailwind CSS"), "@tailwindcss/postcss": ("tooling", "Tailwind CSS"), "vitest": ("testing", "Vitest"),
    "@playwright/test": ("testing", "Playwright"), "playwright": ("testing", "Playwright"), "jest": ("testing", "Jest"),
    "cypress": ("testing", "Cypress"), "mocha": ("testing", "Mocha"), "@testing-library/react": ("testing", "Testing Library"),
    "prisma": ("database", "Prisma"), "@prisma/client": ("database", "Prisma"), "drizzle-orm": ("database", "Drizzle ORM"),
    "typeorm": ("database", "TypeORM"), "knex": ("database", "Knex"), "kysely": ("database", "Kysely"),
    "mikro-orm": ("database", "MikroORM"), "pg": ("database", "PostgreSQL"), "postgres": ("database", "PostgreSQL"),
    "mysql": ("database", "MySQL"), "mysql2": ("database", "MySQL"), "sqlite3": ("database", "SQLite"),
    "better-sqlite3": ("database", "SQLite"), "mongodb": ("database", "MongoDB"), "mongoose": ("database", "MongoDB"),
    "redis": ("external", "Redis"), "ioredis": ("external", "Redis"), "stripe": ("external", "Stripe"), "openai": ("external", "OpenAI"),
    "@anthropic-ai/sdk": ("external", "Anthropic"), "@supabase/supabase-js": ("external", "Supabase"),
    "firebase": ("external", "Firebase"), "firebase-admin": ("external", "Firebase"), "kafkajs": ("external", "Kafka"),
    "amqplib": ("external", "RabbitMQ"), "graphql": ("external", "GraphQL"), "@apollo/server": ("external", "GraphQL"),
    "@apollo/client": ("external", "GraphQL"), "@grpc/grpc-js": ("external", "gRPC"), "twilio": ("external", "Twilio"),
    "resend": ("external", "Resend"), "@sendgrid/mail": ("external", "SendGrid"), "@aws-sdk/client-s3": ("external", "AWS"),
}

# Technologies by Python package.
PYTHON_TECH = {
    "fastapi": ("framework", "FastAPI"), "flask": ("framework", "Flask"), "django": ("framework", "Django"),
    "tornado": ("framework", "Tornado"), "sanic": ("framework", "Sanic"), "litestar": ("framework", "Litestar"),
    "starlette": ("framework", "Starlette"), "sqlalchemy": ("database", "SQLAlchemy"), "sqlmodel": ("database", "SQLModel"),
    "tortoise-orm": ("database", "Tortoise ORM"), "peewee": ("database", "Peewee"), "beanie": ("database", "Beanie"),
    "motor": ("database", "MongoDB"), "pymongo": ("database", "MongoDB"), "alembic": ("database", "Alembic"),
    "psycopg": ("database", "PostgreSQL"), "psycopg2": ("database", "PostgreSQL"), "psycopg2-binary": ("database", "PostgreSQL"),
    "asyncpg": ("database", "PostgreSQL"), "aiomysql": ("database", "MySQL"), "aiosqlite": ("database", "SQLite"),
    "redis": ("external", "Redis"), "celery": ("external", "Celery"), "stripe": ("external", "Stripe"), "openai": ("external", "OpenAI"),
    "anthropic": ("external", "Anthropic"), "supabase": ("external", "Supabase"), "boto3": ("external", "AWS"),
    "pika": ("external", "RabbitMQ"), "aiokafka": ("external", "Kafka"), "kafka-python": ("external", "Kafka"),
    "grpcio": ("external", "gRPC"), "strawberry-graphql": ("external", "GraphQL"), "graphene": ("external", "GraphQL"),
    "sendgrid": ("external", "SendGrid"), "resend": ("external", "Resend"), "twilio": ("external", "Twilio"),
    "httpx": ("external", "HTTPX"), "aiohttp": ("external", "aiohttp"), "pytest": ("testing", "pytest"),
    "unittest": ("testing", "unittest"), "ruff": ("tooling", "Ruff"), "mypy": ("tooling", "mypy"),
}

# Tags by the root of an imported Python module.
PYTHON_ROOTS = {
    "stripe": [("external", "Stripe")], "redis": [("external", "Redis")], "boto3": [("external", "AWS")],
    "openai": [("external", "OpenAI")], "anthropic": [("external", "Anthropic")], "supabase": [("external", "Supabase")],
    "firebase_admin": [("external", "Firebase")], "kafka": [("external", "Kafka")], "aiokafka": [("external", "Kafka")],
    "celery": [("external", "Celery")], "pika": [("external", "RabbitMQ")], "sendgrid": [("external", "SendGrid")],
    "resend": [("external", "Resend")], "twilio": [("external", "Twilio")], "pymongo": [("external", "MongoDB")],
    "motor": [("external", "MongoDB")], "httpx": [("external", "HTTPX")], "aiohttp": [("external", "aiohttp")],
    "fastapi": [("framework", "FastAPI")], "flask": [("framework", "Flask")], "django": [("framework", "Django")],
    "sqlalchemy": [("framework", "SQLAlchemy"), ("database", "SQL database")],
    "sqlmodel": [("framework", "SQLModel"), ("database", "SQL database")],
    "tortoise": [("framework", "Tortoise ORM"), ("database", "SQL database")],
    "peewee": [("framework", "Peewee"), ("database", "SQL database")],
    "beanie": [("framework", "Beanie"), ("database", "MongoDB")],
}

# Tags by the root of an imported JavaScript module (the root itself, or a scope before '/').
SCRIPT_ROOTS = {
    "external": {
        "stripe": "Stripe", "ioredis": "Redis", "redis": "Redis", "@aws-sdk": "AWS", "aws-sdk": "AWS", "openai": "OpenAI",
        "@anthropic-ai": "Anthropic", "@supabase": "Supabase", "firebase": "Firebase", "kafkajs": "Kafka", "amqplib": "RabbitMQ",
        "@sendgrid": "SendGrid", "resend": "Resend", "twilio": "Twilio", "mongodb": "MongoDB", "mongoose": "MongoDB",
        "graphql": "GraphQL", "@apollo": "GraphQL", "@grpc": "gRPC",
    },
    "framework": {
        "react": "React", "next": "Next.js", "express": "Express", "@nestjs": "NestJS", "vite": "Vite", "vitest": "Vitest",
        "playwright": "Playwright", "@playwright": "Playwright", "vue": "Vue", "nuxt": "Nuxt", "svelte": "Svelte",
        "@sveltejs": "SvelteKit", "astro": "Astro", "@remix-run": "Remix", "hono": "Hono", "fastify": "Fastify",
    },
    "database": {
        "@prisma": "Prisma", "prisma": "Prisma", "drizzle-orm": "Drizzle ORM", "typeorm": "TypeORM", "pg": "PostgreSQL",
        "postgres": "PostgreSQL", "mysql": "MySQL", "mysql2": "MySQL", "sqlite": "SQLite", "better-sqlite3": "SQLite",
        "mongodb": "MongoDB", "mongoose": "MongoDB", "@supabase": "Supabase",
    },
}

# Environment variables that show a technology.
ENVIRONMENT = {
    "PostgreSQL": r"\b(?:DATABASE_URL|POSTGRES(?:QL)?_URL|PGHOST)\b",
    "Redis": r"\b(?:REDIS_URL|REDIS_HOST)\b",
    "MongoDB": r"\b(?:MONGO(?:DB)?_URI|MONGODB_URL)\b",
    "Stripe": r"\bSTRIPE_(?:SECRET_KEY|API_KEY|WEBHOOK_SECRET)\b",
    "OpenAI": r"\bOPENAI_API_KEY\b",
    "Anthropic": r"\bANTHROPIC_API_KEY\b",
    "Supabase": r"\bSUPABASE_(?:URL|KEY|ANON_KEY)\b",
    "AWS": r"\bAWS_(?:ACCESS_KEY_ID|REGION|S3_BUCKET)\b",
    "SendGrid": r"\bSENDGRID_API_KEY\b",
    "Resend": r"\bRESEND_API_KEY\b",
    "Twilio": r"\bTWILIO_(?:ACCOUNT_SID|AUTH_TOKEN)\b",
}
ENVIRONMENT_SKIPS = [".md", ".mdx", ".txt", ".rst"]

# Patterns of JavaScript facts.
NAME = r"[A-Za-z_$][\w$]*"
JS_IMPORT = r"""(?:import\s+([\s\S]*?)\s+from\s+|import\s*\(|require\s*\()["']([^"']+)["']"""
JS_CLASS = rf"\bclass\s+({NAME})"
JS_INTERFACE = rf"\binterface\s+({NAME})"
JS_TYPE = rf"\btype\s+({NAME})\s*="
JS_FUNCTION = rf"(?:async\s+)?function\s+({NAME})\s*\(|(?:const|let|var)\s+({NAME})\s*=\s*(?:async\s*)?(?:\([^)]*\)|{NAME})\s*=>"
JS_EXPORT = r"^\s*export\s+(?:default\s+)?"
JS_RECEIVER = rf"\b(?:const|let|var)\s+({NAME})\s*=\s*(?:express\s*\(|(?:express\.)?Router\s*\()"
JS_ROUTE = rf"""(?i)\b({NAME})\.(get|post|put|patch|delete|options|head|all)\s*\(\s*["']([^"']+)["']\s*,\s*({NAME})?"""
JS_MOUNT = rf"\b({NAME})\.use\s*\("
JS_CALL = rf"\b({NAME}(?:\.{NAME})*)\s*\("
JS_NO_CALL = ["if", "for", "while", "switch", "function", "catch", "return"]
NEST_CONTROLLER = r"""@Controller\s*\(\s*["']([^"']*)["']\s*\)"""
NEST_ROUTE = rf"""(?i)@(Get|Post|Put|Patch|Delete|Options|Head|All)\s*\(\s*(?:["']([^"']*)["'])?\s*\)\s*\n\s*(?:async\s+)?({NAME})\s*\("""
NEXT_ROUTE = r"export\s+(?:async\s+)?function\s+(GET|POST|PUT|PATCH|DELETE|OPTIONS|HEAD)\b"
NEXT_ROUTE_NAMES = ["route.ts", "route.js", "route.tsx", "route.jsx"]
JS_SUFFIXES = [".js", ".jsx", ".mjs", ".cjs", ".ts", ".tsx"]
PY_SUFFIXES = [".py", ".pyi"]
JS_ENTRY_NAMES = ["index.js", "index.ts", "server.js", "server.ts", "main.js", "main.ts"]
JS_CANDIDATE_SUFFIXES = [".ts", ".tsx", ".js", ".jsx", ".mjs", ".cjs", ".json"]
SQL_WORDS = r"(?i)\b(?:SELECT|INSERT\s+INTO|UPDATE|DELETE\s+FROM)\b"
HTTP_VERBS = ["get", "post", "put", "patch", "delete", "options", "head", "websocket"]

# Confidence of routes and calls.
ROUTE_CONFIDENCE = {"decorator": 0.98, "Express": 0.96, "NestJS": 0.95, "Next.js app": 0.94, "Next.js pages": 0.90, "Django": 0.88}
CALL_IMPORTED, CALL_LOCAL, CALL_DOTTED, CALL_BARE, CALL_OPEN = 0.92, 0.88, 0.82, 0.72, 0.55

# Admissions in ten minutes, public and signed in.
WINDOW_MS, PUBLIC_LIMIT, USER_LIMIT = 600_000, 5, 20

# Telemetry keys that are never passed on, and values with '/' that are.
BLOCKED_KEYS = [
    "url", "repo", "repository", "name", "repo_name", "path", "file_path", "filename", "symbol", "symbol_name", "code", "content",
    "source", "stack", "token", "access_token", "email",
]
ALLOWED_VALUES = ["<5s", "5-15s", "15-30s", ">30s", "4/5", "5/5", "1/5", "2/5", "3/5"]
