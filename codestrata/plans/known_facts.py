"""Facts of the files that ``sources.corpus`` writes, read off their texts by hand: what the extraction queries have to find.

``per_document`` turns rows with $ID into SQL over the documents table.
"""

from __future__ import annotations

from ..sources.corpus import REPO_SQL

API, SVC, MODEL, BAD = "backend/api/orders_$ID.py", "backend/services/billing_$ID.py", "backend/models/ledger_$ID.py", "backend/broken_$ID.py"
SERVER, SHOP, NESTED, LOOSE = "srv_$ID/server.js", "srv_$ID/routes/shop_$ID.js", "srv_$ID/routes/nested_$ID.js", "srv_$ID/routes/loose_$ID.js"
PANEL, LIB, NEST = "web/src/panel_$ID.tsx", "web/src/lib/items_$ID.ts", "nest/orders_$ID.controller.ts"
CART, PING = "next/app/(shop)/cart_$ID/route.ts", "next/pages/api/ping_$ID.ts"

PY_SYMBOLS = [
    (API, API, "module", "orders_$ID.py", 1, 17, None), (API, f"{API}::read_order", "function", "read_order", 9, 11, None),
    (API, f"{API}::add_order", "function", "add_order", 15, 16, None), (SVC, SVC, "module", "billing_$ID.py", 1, 13, None),
    (SVC, f"{SVC}::load_orders", "function", "load_orders", 6, 7, None), (SVC, f"{SVC}::Billing", "class", "Billing", 10, 12, None),
    (SVC, f"{SVC}::Billing::fetch", "method", "fetch", 11, 12, f"{SVC}::Billing"), (MODEL, MODEL, "module", "ledger_$ID.py", 1, 16, None),
    (MODEL, f"{MODEL}::Base", "database_model", "Base", 4, 5, None), (MODEL, f"{MODEL}::Ledger", "database_model", "Ledger", 8, 11, None),
    (MODEL, f"{MODEL}::Ledger::build_$ID", "method", "build_$ID", 10, 11, f"{MODEL}::Ledger"),
]
#: (file, line, module, names, target)
PY_IMPORTS = [
    (API, 1, "fastapi", ["APIRouter", "Depends"], None), (API, 2, "backend.services.billing_$ID", ["load_orders", "Billing"], SVC),
    (API, 3, "..models", ["ledger_$ID"], MODEL), (SVC, 1, "redis", ["redis"], None), (SVC, 1, "backend.models.ledger_$ID", ["books"], MODEL), (SVC, 1, "sys", ["sys"], None), (SVC, 2, "os.path", ["osp"], None),
    (SVC, 3, "backend.models.ledger_$ID", ["Ledger"], MODEL), (MODEL, 1, "sqlalchemy.orm", ["DeclarativeBase"], None),
]
#: (file, source, callee, line)
PY_CALLS = [
    (API, f"{API}::read_order", "Billing", 10), (API, f"{API}::read_order", "billing.fetch", 11), (API, f"{API}::read_order", "router.get", 8),
    (API, f"{API}::add_order", "load_orders", 16), (API, f"{API}::add_order", "router.post", 14),
    (SVC, f"{SVC}::load_orders", "Ledger.build_$ID", 7), (SVC, f"{SVC}::Billing::fetch", "load_orders", 12),
    (MODEL, f"{MODEL}::Ledger::build_$ID", "cls", 11),
]
#: (file, source, callee, receiver, arguments, assigned_to, argument_count, line)
PY_CALL_TEXTS = [
    (API, API, "APIRouter", None, 'prefix="/v$ID"', "router", 1, 5), (API, f"{API}::read_order", "router.get", "router", '"/orders/{key}"', None, 1, 8),
    (API, f"{API}::read_order", "Billing", None, "", "billing", 0, 10), (API, f"{API}::read_order", "billing.fetch", "billing", "key", None, 1, 11),
    (API, f"{API}::add_order", "router.post", "router", '"orders"', None, 1, 14), (API, f"{API}::add_order", "load_orders", None, "body", None, 1, 16),
    (SVC, f"{SVC}::load_orders", "Ledger.build_$ID", "Ledger", "body", None, 1, 7), (SVC, f"{SVC}::Billing::fetch", "load_orders", None, "key", None, 1, 12),
    (MODEL, f"{MODEL}::Ledger::build_$ID", "cls", None, "", None, 0, 11), (MODEL, MODEL, "print", None, '"postgresql://db/$ID"', None, 1, 15),
]
#: (file, method, path, handler, line, framework, confidence)
PY_ROUTES = [
    (API, "GET", "/v$ID/orders/{key}", f"{API}::read_order", 9, "FastAPI", 0.98), (API, "POST", "/v$ID/orders", f"{API}::add_order", 15, "FastAPI", 0.98),
]
JS_IMPORTS = [
    (SERVER, 1, "express", ["express"], None), (SERVER, 2, "./routes/shop_$ID", ["shop"], SHOP), (SERVER, 3, "./routes/loose_$ID", ["adminRouter"], LOOSE),
    (SHOP, 1, "express", ["express"], None), (SHOP, 3, "./nested_$ID", ["nested"], NESTED), (NESTED, 1, "express", ["Router"], None),
    (LOOSE, 1, "express", ["Router"], None), (PANEL, 1, "react", ["React", "useState", "state"], None),
    (PANEL, 2, "@/lib/items_$ID", ["loadItems"], LIB),
]
#: (file, id, type, name, line, exported)
JS_SYMBOLS = [
    (SERVER, SERVER, "module", "server.js", 1, False), (SHOP, SHOP, "module", "shop_$ID.js", 1, False), (SHOP, f"{SHOP}::listItems", "function", "listItems", 4, False),
    (NESTED, NESTED, "module", "nested_$ID.js", 1, False), (LOOSE, LOOSE, "module", "loose_$ID.js", 1, False), (PANEL, PANEL, "module", "panel_$ID.tsx", 1, False),
    (PANEL, f"{PANEL}::Props", "interface", "Props", 3, True), (PANEL, f"{PANEL}::Panel$ID", "component", "Panel$ID", 4, True),
    (LIB, LIB, "module", "items_$ID.ts", 1, False), (LIB, f"{LIB}::Item", "type", "Item", 1, True), (LIB, f"{LIB}::loadItems", "function", "loadItems", 2, True),
    (NEST, NEST, "module", "orders_$ID.controller.ts", 1, False), (NEST, f"{NEST}::OrdersController", "class", "OrdersController", 2, True),
    (CART, CART, "module", "route.ts", 1, False), (CART, f"{CART}::GET", "function", "GET", 1, True), (CART, f"{CART}::POST", "function", "POST", 4, True),
    (PING, PING, "module", "ping_$ID.ts", 1, False), (PING, f"{PING}::ping", "function", "ping", 1, True),
]
JS_CALLS = [
    (SHOP, f"{SHOP}::listItems", "listItems", 4), (SHOP, f"{SHOP}::listItems", "sendItems", 5), (SHOP, f"{SHOP}::listItems", "router.get", 7),
    (SHOP, f"{SHOP}::listItems", "router.post", 8), (SHOP, f"{SHOP}::listItems", "res.json", 9), (SHOP, f"{SHOP}::listItems", "router.use", 11),
    (PANEL, f"{PANEL}::Panel$ID", "loadItems", 5), (LIB, f"{LIB}::loadItems", "loadItems", 2), (LIB, f"{LIB}::loadItems", "fetch", 3),
    (NEST, f"{NEST}::OrdersController", "Get", 3), (NEST, f"{NEST}::OrdersController", "findOne", 4), (NEST, f"{NEST}::OrdersController", "this.service.find", 5),
    (CART, f"{CART}::GET", "GET", 1), (CART, f"{CART}::GET", "Response.json", 2), (CART, f"{CART}::POST", "POST", 4), (CART, f"{CART}::POST", "GET", 5),
    (PING, f"{PING}::ping", "ping", 1), (PING, f"{PING}::ping", "res.json", 2),
]
JS_ROUTES = [
    (SHOP, "GET", "/items", f"{SHOP}::listItems", 7, "Express", 0.96), (SHOP, "POST", "/items/:id", f"{SHOP}::anonymous@8", 8, "Express", 0.96),
    (NESTED, "DELETE", "/:key", f"{NESTED}::dropItem", 3, "Express", 0.96), (LOOSE, "GET", "/loose", f"{LOOSE}::showLoose", 3, "Express", 0.96),
    (NEST, "GET", "/orders-$ID/:id", f"{NEST}::findOne", 3, "NestJS", 0.95), (CART, "GET", "/cart_$ID", f"{CART}::GET", 1, "Next.js", 0.94),
    (CART, "POST", "/cart_$ID", f"{CART}::POST", 4, "Next.js", 0.94), (PING, "ANY", "/api/ping_$ID", f"{PING}::ping", 1, "Next.js", 0.9),
]
#: (file, line, receiver, prefix, prefix_expression, target_expression, dynamic, target, state)
MOUNTS = [
    (SERVER, 5, "app", "/", None, "express.json({ limit: 1 })", True, None, None), (SERVER, 6, "app", "/api", "'/api'", "shop", False, SHOP, "resolved"),
    (SERVER, 7, "app", None, "pathPrefix", "adminRouter", True, LOOSE, "unresolved"), (SHOP, 11, "router", "/deep", "'/deep'", "nested", False, NESTED, "resolved"),
]
MOUNTED = {(SHOP, "/items"): "/api/items", (SHOP, "/items/:id"): "/api/items/:id", (NESTED, "/:key"): "/api/deep/:key"}
ROUTES = PY_ROUTES + [(f, m, MOUNTED.get((f, p), p), *r) for f, m, p, *r in JS_ROUTES]
#: (file, code, message)
DIAGNOSTICS = [
    (SERVER, "DYNAMIC_ROUTE_MOUNT_UNRESOLVED", 'Could not resolve dynamic Express mount "app.use(pathPrefix, adminRouter)" at line 7; routes beneath this mount may be missing or have incomplete paths.'),
    (LOOSE, "EXPRESS_ROUTE_PATH_INCOMPLETE", f'Full mounted path unresolved for GET /loose; this is the router-local path from {LOOSE}:3. Runtime mount "app.use(pathPrefix, adminRouter)" at {SERVER}:7 could not be followed statically.'),
]
#: (file, category, tech)
USED = [
    (API, "framework", "FastAPI"), (SVC, "external", "Redis"), (MODEL, "framework", "SQLAlchemy"), (MODEL, "database", "SQL database"), (MODEL, "database", "PostgreSQL"),
    (SERVER, "framework", "Express"), (SHOP, "framework", "Express"), (NESTED, "framework", "Express"), (LOOSE, "framework", "Express"), (PANEL, "framework", "React"),
    (NEST, "framework", "NestJS"), (CART, "framework", "Next.js"), (PING, "framework", "Next.js"),
]


def _value(x: object) -> str:
    if x is None:
        return "NULL"
    if isinstance(x, bool):
        return str(x).lower()
    if isinstance(x, list):
        return "[" + ", ".join(map(_value, x)) + "]"
    return "'" + x.replace("'", "''") + "'" if isinstance(x, str) else str(x)


def _filled(name: str, sample: object) -> str:
    if isinstance(sample, list):
        return f"list_transform(t.{name}, lambda v: replace(v, '$ID', CAST(doc_id AS VARCHAR))) AS {name}"
    if isinstance(sample, str):
        return f"replace(t.{name}, '$ID', CAST(doc_id AS VARCHAR)) AS {name}"
    return f"CAST(t.{name} AS {'DOUBLE' if isinstance(sample, float) else 'BOOLEAN' if isinstance(sample, bool) else 'INTEGER'}) AS {name}"


def per_document(columns: str, rows: list[tuple]) -> str:
    """SQL for the rows once per document, with its repository and $ID filled in."""
    names = columns.split()
    samples = [next((r[i] for r in rows if r[i] is not None), "") for i in range(len(names))]
    values = ", ".join("(" + ", ".join(map(_value, r)) + ")" for r in rows)
    return f"SELECT {REPO_SQL.format(text='VARCHAR').replace('source', 'd.source')} AS repo, {', '.join(map(_filled, names, samples))} FROM documents d, (VALUES {values}) t({', '.join(names)})"


def per_repository(columns: str, rows: list[tuple]) -> str:
    """SQL for the rows once per repository, $ID being its least document."""
    return f"WITH whole AS (SELECT DISTINCT ON (source, doc_id % 97) source, doc_id FROM documents ORDER BY doc_id) {per_document(columns, rows).replace('FROM documents d', 'FROM whole d')}"
