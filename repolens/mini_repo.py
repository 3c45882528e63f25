"""A small code base of our own for the extraction queries; the test tables hold no code."""

FILES = [
    ("routes/web.php", "php", "<?php\nuse App\\Http\\Controllers\\UserController;\nRoute::get('/users', [UserController::class, 'index']);\nRoute::post('/pay', 'Shop\\PayController@store');\n"),
    ("app/Http/Controllers/UserController.php", "php", "<?php\nnamespace App\\Http\\Controllers;\n/**\n * Lists users.\n * @author none\n */\nclass UserController extends Controller implements Listing, Sorting\n{\n    public function index(int $page = 1): array\n    {\n        User::query();\n        return app(UserService::class)->list($page);\n    }\n    private static function helper()\n    {\n        dispatch(new SyncJob);\n    }\n}\n"),
    ("app/Http/Controllers/PayController.php", "php", "<?php\nclass PayController {\n    public function store() { SyncJob::dispatch($x); Save(); }\n}\n"),
    ("app/Models/User.php", "php", "<?php\nclass User {}\n"),
    ("app/Services/UserService.php", "php", "<?php\nfinal class UserService { public function list($p) { return wrap($p); } }\n"),
    ("app/Jobs/SyncJob.php", "php", "<?php\nclass SyncJob\n{\n    public function handle() { foreach ($a as $b) { work($b); } }\n}\n"),
    ("tests/PayTest.php", "php", "<?php\nclass PayTest extends TestCase { }\n"),
    ("a.go", "go", "package main\n\nimport \"fmt\"\n\ntype Store struct {\n\tn int\n}\n\ntype Saver interface {\n\tSave() error\n}\n\nfunc (s *Store) Put(x int) { s.n = x; Save(x) }\n\nfunc Handle() { Save(1) }\n"),
    ("b.go", "go", "package main\n\nfunc Save(x int) { fmt.Println(x) }\n"),
    ("web/app.ts", "typescript", "import { a } from 'x';\nimport util from './util';\nexport class Cart {\n  add(item: string) {\n    total(item);\n  }\n  static async load() {}\n}\nconst price = 3;\nfunction total(x) { return price; }\ntype Row = {};\n"),
    ("web/view.jsx", "javascriptreact", "class View {\n  render() {\n    if (ok()) { draw(); }\n  }\n}\nlet helper = () => 1;\n"),
    ("tool.py", "python", "from a.b import c\nimport os\ndef run(x):\n    return helper(x)\n"),
    ("script.lua", "lua", "function go_on(x)\n  const y = f(x)\nend\n"),
    ("empty.md", "markdown", ""),
]

PATHS = [
    ".git/config", "node_modules/x/index.js", "src/vendor/lib.php", "src/main.go", "storage/logs/today.md", "app/storage/logs.md", ".env", "app.min.js", "a/b/logo.png",
    "composer.lock", "yarn.lock", "notes/readme.md", "src/App.TSX", "conf/app.yml", "build/out.js", "builder/out.js", "x.unknown", "Makefile", "lib/mod.mjs",
]

PROJECTS = [("root", "/srv"), ("shop", "/srv/shop"), ("shop2", "/srv/shop2"), ("web", "/srv/shop/web")]
LOOKUPS = ["/srv/shop/web/a.ts", "/srv/shop/api.go", "/srv/shop2/b.go", "/srv/x", "/srv", "/other/y"]


def sql_text(s: str) -> str:
    """An SQL literal; line ends and tabs by number, so that any dialect reads them alike."""
    out = "'" + s.replace("'", "''") + "'"
    for c in ("\n", "\t"):
        out = out.replace(c, f"' || chr({ord(c)}) || '")
    return f"({out})"


def values(name: str, columns: str, rows: list[tuple]) -> str:
    """A common table expression of literals."""
    body = ", ".join("(" + ", ".join(sql_text(x) if isinstance(x, str) else str(x) for x in r) + ")" for r in rows)
    return f"{name}({columns}) AS (VALUES {body})"
