"""Source trees made from tables, for data sets without code.

``code_files`` writes a few fixed files for each document, so that their facts are known from the texts below. ``part_files`` and its
kin read parts as files, order lines as imports and calls, and orders as symbols, so that graphs get the size and skew of the data.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.columns import fixed_table

#: Files of each document; $ID stands for its number.
TEMPLATES = {
    "backend/api/orders_$ID.py": """from fastapi import APIRouter, Depends
from backend.services.billing_$ID import load_orders, Billing
from ..models import ledger_$ID as ledger

router = APIRouter(prefix="/v$ID")


@router.get("/orders/{key}")
def read_order(key):
    billing = Billing()
    return billing.fetch(key)


@router.post("orders")
async def add_order(body):
    return load_orders(body)
""",
    "backend/services/billing_$ID.py": """import redis, backend.models.ledger_$ID as books, sys
import os.path as osp
from backend.models.ledger_$ID import Ledger


def load_orders(body):
    return Ledger.build_$ID(body)


class Billing:
    def fetch(self, key):
        return load_orders(key)
""",
    "backend/models/ledger_$ID.py": """from sqlalchemy.orm import DeclarativeBase


class Base(DeclarativeBase):
    pass


class Ledger(Base):
    @classmethod
    def build_$ID(cls, body):
        return cls()


if __name__ == "__main__":
    print("postgresql://db/$ID")
""",
    "backend/broken_$ID.py": """def half(:
    pass

class Whole:
    pass
""",
    "srv_$ID/server.js": """const express = require('express');
const shop = require('./routes/shop_$ID');
const { Admin: adminRouter } = require('./routes/loose_$ID');
const app = express();
app.use(express.json({ limit: 1 }));
app.use('/api', shop);
app.use(pathPrefix, adminRouter);
app.listen(process.env.REDIS_URL);
""",
    "srv_$ID/routes/shop_$ID.js": """const express = require('express');
const router = express.Router();
const nested = require('./nested_$ID');
function listItems(req, res) {
  sendItems(res);
}
router.get('/items', listItems);
router.post('/items/:id', (req, res) => {
  res.json({});
});
router.use('/deep', nested);
module.exports = router;
""",
    "srv_$ID/routes/nested_$ID.js": """const { Router } = require('express');
const api = Router();
api.delete("/:key", dropItem);
module.exports = api;
""",
    "srv_$ID/routes/loose_$ID.js": """const { Router } = require('express');
const router = Router();
router.get('/loose', showLoose);
module.exports = router;
""",
    "web/src/panel_$ID.tsx": """import React, { useState as state } from 'react';
import { loadItems } from '@/lib/items_$ID';
export interface Props { id: string }
export const Panel$ID = (props) => {
  return loadItems(props);
};
""",
    "web/src/lib/items_$ID.ts": """export type Item = { id: string };
export async function loadItems(props) {
  return fetch('/api/items');
}
""",
    "nest/orders_$ID.controller.ts": """@Controller('orders-$ID')
export class OrdersController {
  @Get(':id')
  async findOne(id) {
    return this.service.find(id);
  }
}
""",
    "next/app/(shop)/cart_$ID/route.ts": """export async function GET(request) {
  return Response.json({});
}
export function POST(request) {
  return GET(request);
}
""",
    "next/pages/api/ping_$ID.ts": """export default function ping(req, res) {
  res.json({});
}
""",
}

#: Files of each repository; $ID stands for the least number in it.
MANIFESTS = {
    "package.json": """{"main": "srv_$ID/server.js", "dependencies": {"express": "4", "@nestjs/core": "10", "left-pad": "1"},
 "devDependencies": {"vitest": "1"}, "scripts": {"start": "node srv_$ID/server.js", "lint": "eslint ."}}
""",
    "tsconfig.json": """{
  // aliases
  "compilerOptions": {"baseUrl": ".", "paths": {"@/*": ["web/src/*"],},}
}
""",
    "pyproject.toml": """[project]
dependencies = ["httpx>=1", "SQLAlchemy[asyncio]~=2"]

[project.optional-dependencies]
dev = ["pytest<9"]
""",
    "requirements.txt": "fastapi==0.1\nredis>=4\nmy-redis-fork\n",
    "Dockerfile": 'FROM node\nCMD ["node", "srv_$ID/server.js"]\n',
    "docker-compose.yml": "services: {}\n",
    "db/schema.sql": "SELECT 1;\n",
    "config/settings.py": 'import os\nKEY = os.environ["STRIPE_API_KEY"]\nURL = os.environ["DATABASE_URL"]\nOTHER = os.environ.get("DATABASE_URL")\n',
    "docs/notes.md": "Set OPENAI_API_KEY first.\n",
}

REPO_SQL = "concat(source, '/', CAST(doc_id % 97 AS {text}))"


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def code_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(repo, path, content, bytes, file_ord) of all documents: repositories are sources, split by number."""
    d = documents(spark, sf_dir).select(F.expr(REPO_SQL.format(text="STRING")).alias("repo"), F.col("doc_id").alias("n"))
    # Narrow rows are dealt out before each of them becomes many files.
    d = d.repartition(spark.sparkContext.defaultParallelism, "n")
    each = d.crossJoin(F.broadcast(fixed_table(spark, [(p, c) for p, c in TEMPLATES.items()], "path string, content string")))
    whole = d.groupBy("repo").agg(F.min("n").alias("n")).crossJoin(F.broadcast(fixed_table(spark, [(p, c) for p, c in MANIFESTS.items()], "path string, content string")))
    filled = lambda c: F.replace(F.col(c), F.lit("$ID"), F.col("n").cast("string"))
    f = each.unionByName(whole.select(each.columns)).select("repo", filled("path").alias("path"), filled("content").alias("content"))
    return f.withColumn("bytes", F.octet_length("content").cast("long"))


#: Directory of a part's file by its key; the same list is used by the oracles.
PART_DIRS = ["api", "services", "models", "lib", "tests", "web/components", "core", "jobs", "infra", "repositories", "src", "config", "tools"]
PART_NAMES = ["main.py", "app.py", "index.ts", "server.js"]
#: A repository holds about so many parts, so their number grows with the table.
REPO_PARTS = 100
PART_REPO = "concat('r', CAST({k} % {repos} AS {text}))"
#: Sizes that the shape of the graph depends on, as SQL: repositories, files that have symbols, and symbols that are called.
SIZES_SQL = {
    "repos": f"(SELECT greatest(count(*) // {REPO_PARTS}, 1) FROM part)",
    "coded": "(SELECT count(*) - count(*) // 200 FROM part)",
    "called": "(SELECT greatest(count(*) * 14 // 15, 1) FROM orders)",
}


def sizes(parts: int, orders: int) -> dict[str, str]:
    """The same sizes as literals."""
    return {"repos": str(max(parts // REPO_PARTS, 1)), "coded": str(max(parts - parts // 200, 1)), "called": str(max(orders * 14 // 15, 1))}


def part_path_sql(key: str, text: str) -> str:
    """SQL of a part's path: one of the directories, and a file named by its key, or (one in 29) by an entry name in a directory of its own."""
    dirs = "CASE " + " ".join(f"WHEN {key} % {len(PART_DIRS)} = {i} THEN '{d}'" for i, d in enumerate(PART_DIRS)) + " END"
    names = "CASE " + " ".join(f"WHEN {key} % {len(PART_NAMES)} = {i} THEN '{d}'" for i, d in enumerate(PART_NAMES)) + " END"
    ext = f"CASE WHEN {key} % 13 = 11 THEN '.yml' WHEN {key} % 3 = 0 THEN '.ts' ELSE '.py' END"
    n = f"CAST({key} AS {text})"
    return f"CASE WHEN {key} % 29 = 0 THEN concat({dirs}, '/p', {n}, '/', {names}) ELSE concat({dirs}, '/m', {n}, {ext}) END"


def part_files_sql(text: str, repos: str) -> str:
    return f"SELECT {PART_REPO.format(k='p_partkey', text=text, repos=repos)} AS repo, {part_path_sql('p_partkey', text)} AS path, p_name AS content, CAST(p_size AS BIGINT) * 1000 AS bytes, p_partkey AS n FROM part"


def part_imports_sql(text: str, repos: str) -> str:
    """Edges between parts of one repository: distinct pairs of order lines; the target may be missing, then the import is external."""
    t = f"(((l_partkey * 7 + l_suppkey) % {REPO_PARTS * 6 // 5}) * {repos} + l_partkey % {repos})"
    return (
        f"SELECT a.repo, a.path AS file, b.path AS target, e.t AS ord, b.path IS NULL AS external "
        f"FROM (SELECT DISTINCT l_partkey AS s, {t} AS t FROM lineitem) e JOIN files a ON a.n = e.s LEFT JOIN files b ON b.n = e.t AND b.n <> a.n"
    )


NAMES = ["load", "save", "find", "check", "render", "parse", "merge"]


def symbol_sql(text: str, coded: str) -> str:
    """Orders as symbols of part files: names repeat within and across files, one in three is its own."""
    name = "CASE " + " ".join(f"WHEN o_orderkey % 21 = {i} THEN '{n}'" for i, n in enumerate(NAMES)) + f" WHEN o_orderkey % 3 = 0 THEN concat('only_', CAST(o_orderkey AS {text})) ELSE concat('f', CAST(o_custkey % 400 AS {text})) END"
    kind = "CASE WHEN o_orderkey % 11 = 0 THEN 'class' WHEN o_orderkey % 50 = 3 THEN 'database_model' ELSE 'function' END"
    return (
        f"SELECT repo, path AS file, concat(path, '::', name) AS id, kind AS type, name, line, ord FROM (SELECT f.repo, f.path, {name} AS name, {kind} AS kind, "
        f"CAST(o_orderkey % 300 + 1 AS INT) AS line, o_orderkey AS ord FROM orders JOIN files f ON f.n = o_orderkey % {coded}) s"
    )


def call_sql(text: str, called: str) -> str:
    """Order lines as calls from the symbol of their order; callees are symbol names, some with a qualifier."""
    callee = "CASE WHEN l_linenumber % 2 = 0 THEN concat('obj.', t.name) ELSE t.name END"
    return (
        f"SELECT s.repo, s.file, CAST(l_orderkey * 10 + l_linenumber AS BIGINT) AS ord, s.id AS source, {callee} AS callee, CAST(l_linenumber AS INT) AS line "
        f"FROM (SELECT DISTINCT l_orderkey, l_linenumber, l_partkey FROM lineitem) l JOIN symbols s ON s.ord = l_orderkey JOIN symbols t ON t.ord = (l_orderkey * 3 + l_partkey) % {called}"
    )


def part_graph(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    """files, imports, symbols and calls from parts, order lines and orders."""
    t = {n: spark.read.parquet(f"{sf_dir}/{n}.parquet") for n in ("part", "orders", "lineitem")}
    z = sizes(t["part"].count(), t["orders"].count())
    t["files"] = spark.sql(part_files_sql("STRING", z["repos"]).replace("FROM part", "FROM {part}"), part=t["part"])
    t["imports"] = spark.sql(part_imports_sql("STRING", z["repos"]).replace("FROM lineitem", "FROM {lineitem}").replace("JOIN files", "JOIN {files}"), lineitem=t["lineitem"], files=t["files"])
    t["symbols"] = spark.sql(symbol_sql("STRING", z["coded"]).replace("FROM orders", "FROM {orders}").replace("JOIN files", "JOIN {files}"), orders=t["orders"], files=t["files"])
    # The call SQL in another order of joins: lines are shuffled while they are narrow, and dealt so that telling them apart needs no shuffle of its own.
    key = F.expr(f"(l_orderkey * 3 + l_partkey) % {z['called']}").alias("named")
    lines = t["lineitem"].select("l_orderkey", "l_linenumber", "l_partkey", key).repartition("named").distinct()
    lines = lines.join(t["symbols"].select(F.col("ord").alias("named"), F.col("name").alias("other")), "named").select("l_orderkey", "l_linenumber", "other")
    callee = F.expr("CASE WHEN l_linenumber % 2 = 0 THEN concat('obj.', other) ELSE other END")
    own = t["symbols"].select("repo", "file", F.col("ord").alias("l_orderkey"), F.col("id").alias("source"))
    ord_, line = F.expr("CAST(l_orderkey * 10 + l_linenumber AS BIGINT)"), F.expr("CAST(l_linenumber AS INT)")
    t["calls"] = lines.join(own, "l_orderkey").select("repo", "file", ord_.alias("ord"), "source", callee.alias("callee"), line.alias("line"))
    return t


#: The same tables for the oracles.
PART_GRAPH_SQL = f"""files AS ({part_files_sql("VARCHAR", SIZES_SQL["repos"])}),
imports AS ({part_imports_sql("VARCHAR", SIZES_SQL["repos"])}),
symbols AS ({symbol_sql("VARCHAR", SIZES_SQL["coded"])}),
calls AS ({call_sql("VARCHAR", SIZES_SQL["called"])})"""
