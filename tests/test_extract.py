"""Units of small files in every language; the expected values were worked out by hand."""

import pytest
from pyspark.sql import functions as F

from codelode.functions.hof import first_index, last_index
from codelode.operators import extract as X
from codelode.operators import rules
from codelode.operators.extras import body_extras
from codelode.operators.routes import route_table

FILES = {
    "api/shop.js": """\
const router = require('express').Router();

// Orders of a customer.
router.get('/api/orders', mayRead, needs(['clerk', 'boss']), async (req, res) => {
  const rows = await db.query('SELECT * FROM shop_orders');
  const mail = require('../lib/mail');
  io.emit('orders-read', rows);
  res.json(rows);
});
router.delete('/api/orders/:id', auth, orders.remove);
router.put('/api/orders/:id', orders.change);
""",
    "lib/mixed.js": """\
/**
 * Area of a box.
 * @param {number} w
 */
function area(w, h) {
  return w * h;
}

// ---------------
// Double it.
export const twice = (n) => n * 2;

class Shelf {
  // Put one item.
  async put(item) {
    await db.query('INSERT INTO items (a) VALUES (?)', [item]);
  }

  static open = async (id) => {
    return shelves.get(id);
  };
}

// Every night.
cron.schedule('0 4 * * *', () => {
  sweep();
});
setInterval(beat, 500);
const opts = {
  area: (w) => w,
};
function braces(a = {}, b = "}") {
  const inner = () => 1;
  return [a, b]; // }
}
const wrapped =
  (x) => x;
function below()
{
  return 1;
}
""",
    "web/Page.jsx": """\
import React from 'react';
import { get } from './http';

// Inbox of orders.
export default function OrderPage() {
  const load = () => axios.get(`${BASE}/api/orders?x=1`);
  return (
    <div>{load()}</div>
  );
}
class Old extends React.Component {
  render() { return <p />; }
}
const Plain = () => 1;
""",
    "web/App.js": """\
const App = () => (
  <Switch>
    <Route path="/orders" element={<OrderPage size={1} />} />
    <Route exact path="/old" component={Old} />
  </Switch>
);
const routes = [{ path: '/late', component: OrderPage }, { path: '/plain', element: <Plain /> }];
""",
    "srv/users.controller.ts": """\
@Controller('users')
export class UsersController {
  @Get(':id')
  one(@Param() id: string) {
    return this.s.one(id);
  }

  @Post()
  add(@Body() dto: Dto) {
    return this.s.add(dto);
  }
}
export interface Opts { a: string }
/** Writes dates. */
export class Writer {
  private lang = "en";
  write(d: Date): string {
    return String(d);
  }
  public async since<T>(d: T): Promise<string> {
    return "";
  }
}
enum Kind { A, B }
""",
    "py/app.py": '''\
"""Small service."""
from flask import Flask

@app.route('/api/things', methods=['GET', 'POST'])
def things():
    """List or add things."""
    return db.execute('SELECT * FROM things')


class Box:
    """A box."""

    def add(self, x):
        """
        Add x
        to the box.
        """
        self.items.append(x)

    @property
    def size(self):
        return 1


# Helper.
def helper(
    a,
    b,
):
    def inner():
        pass
    return inner

@celery.task
def nightly():
    pass

@router.get("/x")

# a note
@log
async def late():
    pass

@router.get("/lost")
x = 1
def plain():
    pass
''',
    "go/main.go": """\
// Lists users.
func (s *Server) Users(w http.ResponseWriter, r *http.Request) {
}
func main() {
\tr.HandleFunc("/users", s.Users)
\te.GET("/ping", ping)
}
type Server struct {
\tdb *sql.DB
}
""",
    "rs/lib.rs": """\
/// A point.
pub struct Point { x: i32 }
impl Point {
    /// Make one.
    pub fn new() -> Self { Point { x: 0 } }
}
#[get("/health")]
async fn health() -> &'static str { "ok" }
mod inner {
    fn hidden() {}
}
fn main() {}
""",
    "java/Api.java": """\
package x;
@RequestMapping("/api")
public class Api {
    @GetMapping("/users")
    public List<User> users() {
        return repo.findAll();
    }
    // Save one.
    private void save(User u) throws IOException {
    }
}
""",
    "cs/Api.cs": """\
namespace App.Web
{
    [Route("api/[controller]")]
    public class ItemsController : ControllerBase
    {
        [HttpGet("{id}")]
        public async Task<Item> Get(int id)
        {
            return await _db.Find(id);
        }
        public int Count() => 1;
    }
}
""",
    "kt/Main.kt": """\
data class User(val id: Int)
class Repo {
    // Find.
    fun find(id: Int): User? = null
}
fun main() {
    println("hi")
}
""",
    "swift/App.swift": """\
struct User { let id: Int }
final class Store {
    func load() -> [User] { [] }
    init() {
    }
}
func run() {}
""",
    "rb/user.rb": """\
# A user.
class User < ApplicationRecord
  # Full name.
  def full_name
    "#{first} #{last}"
  end

  def self.by_mail(e)
    where(mail: e).first
  end
end
get '/health' do
  'ok'
end
resources :users
def one = 1
""",
    "php/web.php": """\
<?php
Route::get('/users', [UserController::class, 'index']);
// Helper.
function helper($x) {
    return $x;
}
class Foo {
    #[Attr]
    public function bar() {
    }
}
""",
    "sh/deploy.sh": """\
#!/bin/bash
# Build the app.
build() {
  npm run build # comment with } brace
}
function deploy {
  rsync -a dist/ server:/var/www
}
""",
    "sql/schema.sql": """\
-- Users of the app.
CREATE TABLE IF NOT EXISTS users (
  id INT PRIMARY KEY, -- not; here
  mail TEXT DEFAULT ';'
);
CREATE OR REPLACE VIEW active AS SELECT * FROM users WHERE active = 1;
CREATE FUNCTION total() RETURNS INT AS $$ SELECT COUNT(*) FROM users $$;
""",
    "lib/constants.js": "// Constants.\r\nmodule.exports = { A: 1 };\r\n",
    "docs/guide.md": "# Guide\n\ntext\n",
    "lib/comments.js": "// ======\n// " + "x" * 300 + "\n// ======\nfunction a() {}\n\n"
                       "/* One. */\nfunction b() {}\n\n// Two.\n\nfunction c() {}\n"
                       "// eslint-disable\n// Kept.\nfunction d() {}\n",
    "empty.py": "",
}


@pytest.fixture(scope="session")
def mined(spark):
    rows = [("r", p, t) for p, t in FILES.items()]
    files = spark.createDataFrame(rows, "repo string, path string, text string")
    m = X.mine_files(files, [("order|mail", "shop")])
    units = X.mined_units(m, route_table(files)).collect()
    stats = X.file_stats(m).collect()
    return units, {s.file: s for s in stats}


def of(mined, file):
    return {u.name: u for u in mined[0] if u.file == file}


def spans(mined, file):
    return [(u.start, u.end, u.type, u.name) for u in sorted(
        (u for u in mined[0] if u.file == file), key=lambda u: u.start)]


def test_express(mined):
    units = of(mined, "api/shop.js")
    get = units["GET /api/orders"]
    assert (get.type, get.start, get.end, get.comment) == ("endpoint", 4, 9, "Orders of a customer.")
    assert get.extra.middleware == ["mayRead", "needs(['clerk', 'boss'])"]
    assert get.extra.tables == ["shop_orders"]
    assert get.extra.emits == ["orders-read"] and get.extra.imports == ["../lib/mail"]
    assert get.id == "api/shop.js:4 GET /api/orders"
    assert units["DELETE /api/orders/:id"].extra.middleware == ["auth"]
    assert units["PUT /api/orders/:id"].extra.middleware is None
    assert units["DELETE /api/orders/:id"].end == 10


def test_javascript(mined):
    assert spans(mined, "lib/mixed.js") == [
        (5, 7, "function", "area"), (11, 11, "function", "twice"), (13, 22, "class", "Shelf"),
        (15, 17, "method", "put"), (19, 21, "method", "open"), (25, 27, "job", "cron 0 4 * * *"),
        (28, 28, "job", "interval beat"), (32, 35, "function", "braces"),
        (38, 41, "function", "below"),
    ]
    units = of(mined, "lib/mixed.js")
    assert units["area"].comment == "Area of a box."
    assert units["twice"].comment == "Double it."
    assert units["put"].extra.parent == "Shelf" and units["put"].extra.tables == ["items"]
    assert units["cron 0 4 * * *"].comment == "Every night."


def test_components_and_pages(mined):
    units = of(mined, "web/Page.jsx")
    page = units["OrderPage"]
    assert (page.type, page.extra.route, page.comment) == ("page", "/orders", "Inbox of orders.")
    assert page.extra.calls == ["/api/orders?x=1"]
    assert "load" not in units
    assert (units["Old"].type, units["Old"].extra.route) == ("page", "/old")
    assert units["render"].type == "method"
    assert units["Plain"].type == "function"  # on the route table, but shows no markup
    assert of(mined, "web/App.js")["App"].type == "component"


def test_nest(mined):
    units = of(mined, "srv/users.controller.ts")
    assert units["GET /users/:id"].extra.handler == "one"
    assert units["POST /users"].type == "endpoint"
    assert units["POST /users"].extra.parent == "UsersController"
    assert units["Opts"].extra.kind == "interface" and units["Kind"].extra.kind == "enum"
    assert units["Writer"].comment == "Writes dates."
    assert [u for u in ("write", "since") if units[u].extra.parent == "Writer"] == ["write", "since"]


def test_python(mined):
    units = of(mined, "py/app.py")
    route = units["GET,POST /api/things"]
    assert (route.type, route.start, route.end) == ("endpoint", 5, 7)
    assert (route.comment, route.extra.handler) == ("List or add things.", "things")
    assert route.extra.tables == ["things"]
    assert (units["Box"].comment, units["Box"].end) == ("A box.", 22)
    assert units["add"].comment == "Add x to the box." and units["add"].extra.parent == "Box"
    assert units["size"].type == "method"
    assert (units["helper"].comment, units["helper"].start) == ("Helper.", 26)
    # The line with the closing bracket stands at the indent of the def.
    assert units["helper"].end == 28
    assert "inner" not in units
    assert units["nightly"].type == "job"
    assert units["GET /x"].extra.handler == "late"
    assert units["plain"].type == "function"  # code between forgets the decorator


def test_other_languages(mined):
    go = of(mined, "go/main.go")
    assert (go["Users"].type, go["Users"].extra.parent, go["Users"].comment) == (
        "method", "Server", "Lists users.")
    assert go["ANY /users"].type == go["GET /ping"].type == "endpoint"
    assert go["Server"].type == "class" and go["main"].type == "function"
    rs = of(mined, "rs/lib.rs")
    assert rs["Point"].comment == "A point." and rs["impl Point"].extra.kind == "impl"
    assert (rs["new"].type, rs["new"].extra.parent) == ("method", "impl Point")
    assert rs["GET /health"].type == "endpoint" and rs["main"].type == "function"
    assert rs["hidden"].extra.parent == "inner"
    java = of(mined, "java/Api.java")
    assert java["Api"].type == "class"
    assert java["GET /api/users"].extra.handler == "users"
    assert (java["save"].type, java["save"].comment) == ("method", "Save one.")
    cs = of(mined, "cs/Api.cs")
    assert cs["GET /api/[controller]/{id}"].type == "endpoint"
    assert (cs["Count"].type, cs["Count"].extra.parent) == ("method", "ItemsController")
    kt = of(mined, "kt/Main.kt")
    assert kt["User"].type == "class" and kt["main"].type == "function"
    assert (kt["find"].type, kt["find"].comment) == ("method", "Find.")
    sw = of(mined, "swift/App.swift")
    assert sw["load"].type == sw["init"].type == "method" and sw["run"].type == "function"


def test_script_languages(mined):
    rb = of(mined, "rb/user.rb")
    assert (rb["User"].comment, rb["User"].end) == ("A user.", 11)
    assert (rb["full_name"].type, rb["full_name"].end) == ("method", 6)
    assert rb["by_mail"].type == "method" and rb["GET /health"].end == 14
    assert rb["RESOURCE /users"].extra.path == "users" and rb["one"].end == 16
    php = of(mined, "php/web.php")
    assert php["GET /users"].type == "endpoint" and php["bar"].type == "method"
    assert php["helper"].comment == "Helper."
    sh = of(mined, "sh/deploy.sh")
    assert (sh["build"].comment, sh["build"].end) == ("Build the app.", 5)
    assert sh["deploy"].type == "function"
    sql = of(mined, "sql/schema.sql")
    assert (sql["table users"].comment, sql["table users"].end) == ("Users of the app.", 5)
    assert sql["view active"].extra.kind == "view"
    assert sql["function total"].extra.tables == ["users"]


def test_whole_file_and_header(mined):
    (unit,) = of(mined, "lib/constants.js").values()
    assert (unit.type, unit.name, unit.start, unit.end) == ("file", "constants.js", 1, 3)
    assert unit.comment == "Constants."
    (guide,) = of(mined, "docs/guide.md").values()
    assert (guide.type, guide.lang) == ("file", None)
    (empty,) = of(mined, "empty.py").values()
    assert (empty.start, empty.end, empty.comment) == (1, 1, "")
    stats = mined[1]
    assert stats["py/app.py"].header == "Small service."
    assert stats["sh/deploy.sh"].header == "Build the app."
    assert stats["lib/constants.js"].lines == 3 and stats["lib/constants.js"].n_units == 1
    assert stats["api/shop.js"].area == "api" and stats["empty.py"].area == "root"


def test_comments(mined):
    units = of(mined, "lib/comments.js")
    assert len(units["a"].comment) == 240
    assert (units["b"].comment, units["c"].comment, units["d"].comment) == ("One.", "", "Kept.")


def test_every_id(mined):
    for u in mined[0]:
        assert u.id == f"{u.file}:{u.start} {u.name}" and u.end >= u.start


def test_unit_source(spark):
    text = "\n".join(f"l{i}" for i in range(1, 101))
    df = spark.createDataFrame([(text, 2, 4), (text, 10, 90), (text, 99, 200)],
                               "t string, s int, e int")
    rows = [r[0] for r in df.select(X.unit_source(F.col("t"), F.col("s"), F.col("e"))).collect()]
    assert rows[0] == "l2\nl3\nl4"
    assert rows[1] == "\n".join(f"l{i}" for i in range(10, 70)) + "\n// ... (truncated)"
    assert rows[2] == "l99\nl100\n// ... (truncated)"


def test_route_join_without_broadcast(spark):
    files = spark.createDataFrame(
        [("r", p, FILES[p]) for p in ("web/Page.jsx", "web/App.js")],
        "repo string, path string, text string")
    units = X.mined_units(X.mine_files(files), with_facts=True).cache()
    assert sorted(X.route_table_of(units).collect()) == sorted(route_table(files).collect())
    a = X.with_pages(units, route_table(files)).orderBy("file", "start").collect()
    b = X.with_pages(units, route_table(files), 0).orderBy("file", "start").collect()
    assert a == b and "page" in {u.type for u in a}


def test_rules_are_tried_on_lines_that_one_search_chooses(spark):
    lines = [line for spec in rules.LANGUAGES.values() for r in spec.rules for line in (
        "", "  ", "x = 1", "def f(a):", "class A {", "CREATE table t (", "  get '/x' do", "cron.schedule('1', f)", "func F() {")]
    rows = spark.createDataFrame([(lines,)], "ls array<string>")
    for name, spec in rules.LANGUAGES.items():
        each = F.transform("ls", lambda l: F.exists(F.array(*[F.lit(rules._match_sql(r, "l", True) != "") & l.rlike(
            r.java(True)) for r in spec.rules]), lambda x: x))
        got = rows.select(each.alias("each"), F.transform("ls", lambda l: l.rlike(rules.any_rule(spec, True))).alias("one")).first()
        assert got.each == got.one, name
    assert "|" in rules.any_rule(rules.LANGUAGES["py"], True)


def test_each_search_is_worked_out_once(spark):
    rows = spark.createDataFrame([([0, 0, 1, 1],), ([0, 0, 0, 0],)], "a array<int>")
    arr, hit = F.col("a"), lambda x: x == 1
    found = rows.select(first_index(arr, F.lit(1), [1, 8], hit).alias("f"), last_index(arr, F.lit(3), [1, 8], hit).alias("l"))
    assert [tuple(r) for r in found.collect()] == [(1, 3), (None, None)]
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("array_position(") == 2
    body = spark.createDataFrame([("fetch('/a'); fetch('/b')",), ("x",)], "b string").select(
        *[c.alias(n) for n, c in body_extras(F.col("b"), F.lit("js")).items()])
    assert [r.calls for r in body.collect()] == [["/a", "/b"], None]
    assert body.select("calls")._jdf.queryExecution().optimizedPlan().toString().count("regexp_extract_all(") == 1
