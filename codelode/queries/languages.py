"""Files of many languages derived from the ``part`` table: one fixed file per language, in which
only the key of the part varies. What has to be found in each stands beside it, line by line."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from codelode.sources.scratch import spread

#: Extension and source by number; the key of the part takes the place of @@.
SOURCES: list[tuple[str, str]] = [
    ("ts", """import { Get } from './nest';

// Orders over HTTP.
@Controller('shop@@')
export class Orders@@ {
  // One order.
  @Get(':id')
  async one(id: string): Promise<Order> {
    return this.db.query(`SELECT * FROM lots WHERE id = 1`);
  }

  @Post()
  add(order: Order) {
    const mail = require('./mail');
    mail.send(order);
  }
}

export interface Order@@ {
  id: string;
}

export enum State { Open, Closed }

export default function () {
  setInterval(sweep, 1000);
}
"""),
    ("go", """package stock

// Read@@ reads one.
func Read@@(id int) int {
	return id
}

type Store struct {
	db string
}

// Put keeps it.
func (s *Store) Put(x int) {
	s.db = "UPDATE lots SET x = 1"
}

func routes(r Router) {
	r.GET("/stock/@@", show)
	http.HandleFunc("/all/@@", list)
}
"""),
    ("rs", """/// A shelf.
pub struct Shelf@@ {
    x: u32,
}

impl Shelf@@ {
    /// Puts one.
    pub fn put(&mut self) {
        self.x = 1;
    }
}

impl Clone for Shelf@@ {
    fn clone(&self) -> Self { Shelf@@ { x: 0 } }
}

#[get("/shelf/@@")]
async fn show() -> String {
    String::new()
}

trait Keep {
    fn keep(&self);
}
"""),
    ("java", """package shop;

/**
 * Parts over HTTP.
 */
@RestController
@RequestMapping("/parts@@")
public class Parts@@ {
    // One part.
    @GetMapping("/{id}")
    public Part one(String id) {
        return db.find("SELECT * FROM lots");
    }

    @Scheduled(cron = "0 0 * * *")
    void nightly() {
        clean();
    }

    private int count(int x) {
        return x;
    }
}
"""),
    ("kt", """package shop

// A bin.
data class Bin@@(val x: Int) {
    fun size(): Int {
        return x
    }
}

suspend fun load@@(id: Int): Bin {
    return db.get(id)
}

fun Route.bins() {
    get("/bins/@@") {
        call.respond(1)
    }
}
"""),
    ("cs", """namespace Shop
{
    // Lots over HTTP.
    [Route("api/lots@@")]
    public class Lots@@ : Base
    {
        // One lot.
        [HttpGet("{id}")]
        public async Task<Lot> One(int id)
        {
            return await db.Find("SELECT * FROM lots");
        }

        private int Count(int x) => x;
    }
}
"""),
    ("swift", """// A rack.
public struct Rack@@ {
    init(x: Int) {
        self.x = x
    }

    // Puts one.
    mutating func put(_ y: Int) {
        x = y
    }
}

extension Rack@@ {
    func size() -> Int { return 1 }
}
"""),
    ("php", """<?php
Route::get('/lots/@@', [LotController::class, 'index']);

// Lots of the store.
class LotController@@ extends Controller
{
    // All lots.
    public function index()
    {
        return DB::select("SELECT * FROM lots");
    }
}

function helper@@($x) {
    return $x;
}
"""),
    ("sh", """# Pack it.
pack_@@() {
  tar x
}

function unpack_@@ {
  tar y
}
"""),
    ("rb", """# Shop things.
module Shop@@
  class Lot
    def self.all
      db.query("SELECT * FROM lots")
    end
  end
end

resources :lots@@
"""),
    ("py", """urlpatterns = [
    path('lots/@@/', views.lots),
]


# Any verb.
@router.api_route("/any/@@")
async def anything():
    pass
"""),
    ("sql", """-- Sum of a lot.
CREATE OR REPLACE FUNCTION total_@@(x INT) RETURNS INT AS
SELECT sum(n) FROM lots;

CREATE TRIGGER touch_@@ BEFORE UPDATE ON lots
EXECUTE FUNCTION touch();

CREATE TYPE state_@@ AS ENUM ('open');
"""),
    ("jsx", """export function Lots@@() {
  const store = require('./store');
  import('../lazy/@@');
  return <Table />;
}

export class Panel@@ extends React.Component {
  render() {
    return <div />;
  }
}

const routes = [
  { path: '/panel/@@', component: Panel@@ },
  { path: '/none/@@', element: <Nothing /> },
];

export const App = () => (
  <Route path="/lots/@@" element={<Lots@@ />} />
);

schedule.scheduleJob('0 1 * * *', () => {
  sweep();
});
"""),
]

FIELDS = ("type", "name", "first_line", "last_line", "comment", "method", "path", "handler", "parent",
          "kind", "route", "tables", "imports")
#: What has to be found: number of the source, then the fields of a unit.
FOUND: list[tuple] = [
    (0, 'class', 'Orders@@', 5, 17, 'Orders over HTTP.', None, None, None, None, None, None, 'lots', './mail'),
    (0, 'endpoint', 'GET /shop@@/:id', 8, 10, 'One order.', 'GET', '/shop@@/:id', 'one', 'Orders@@', None, None, 'lots', None),
    (0, 'endpoint', 'POST /shop@@', 13, 16, '', 'POST', '/shop@@', 'add', 'Orders@@', None, None, None, './mail'),
    (0, 'class', 'Order@@', 19, 21, '', None, None, None, None, 'interface', None, None, None),
    (0, 'class', 'State', 23, 23, '', None, None, None, None, 'enum', None, None, None),
    (0, 'function', 'default', 25, 27, '', None, None, None, None, None, None, None, None),
    (0, 'job', 'interval sweep', 26, 26, '', None, None, None, None, None, None, None, None),
    (1, 'function', 'Read@@', 4, 6, 'Read@@ reads one.', None, None, None, None, None, None, None, None),
    (1, 'class', 'Store', 8, 10, '', None, None, None, None, None, None, None, None),
    (1, 'method', 'Put', 13, 15, 'Put keeps it.', None, None, None, 'Store', None, None, 'lots', None),
    (1, 'function', 'routes', 17, 20, '', None, None, None, None, None, None, None, None),
    (1, 'endpoint', 'GET /stock/@@', 18, 18, '', 'GET', '/stock/@@', None, None, None, None, None, None),
    (1, 'endpoint', 'ANY /all/@@', 19, 19, '', 'ANY', '/all/@@', None, None, None, None, None, None),
    (2, 'class', 'Shelf@@', 2, 4, 'A shelf.', None, None, None, None, None, None, None, None),
    (2, 'class', 'impl Shelf@@', 6, 11, '', None, None, None, None, 'impl', None, None, None),
    (2, 'method', 'put', 8, 10, 'Puts one.', None, None, None, 'impl Shelf@@', None, None, None, None),
    (2, 'class', 'impl Clone for Shelf@@', 13, 15, '', None, None, None, None, 'impl', None, None, None),
    (2, 'method', 'clone', 14, 14, '', None, None, None, 'impl Clone for Shelf@@', None, None, None, None),
    (2, 'endpoint', 'GET /shelf/@@', 18, 20, '', 'GET', '/shelf/@@', 'show', None, None, None, None, None),
    (2, 'class', 'Keep', 22, 24, '', None, None, None, None, 'trait', None, None, None),
    (2, 'method', 'keep', 23, 23, '', None, None, None, 'Keep', None, None, None, None),
    (3, 'class', 'Parts@@', 8, 23, 'Parts over HTTP.', None, None, None, None, None, None, 'lots', None),
    (3, 'endpoint', 'GET /parts@@/{id}', 11, 13, 'One part.', 'GET', '/parts@@/{id}', 'one', 'Parts@@', None, None, 'lots', None),
    (3, 'job', 'nightly', 16, 18, '', None, None, None, 'Parts@@', None, None, None, None),
    (3, 'method', 'count', 20, 22, '', None, None, None, 'Parts@@', None, None, None, None),
    (4, 'class', 'Bin@@', 4, 8, 'A bin.', None, None, None, None, None, None, None, None),
    (4, 'method', 'size', 5, 7, '', None, None, None, 'Bin@@', None, None, None, None),
    (4, 'function', 'load@@', 10, 12, '', None, None, None, None, None, None, None, None),
    (4, 'function', 'bins', 14, 18, '', None, None, None, None, None, None, None, None),
    (4, 'endpoint', 'GET /bins/@@', 15, 17, '', 'GET', '/bins/@@', None, None, None, None, None, None),
    (5, 'class', 'Lots@@', 5, 15, 'Lots over HTTP.', None, None, None, 'Shop', None, None, 'lots', None),
    (5, 'endpoint', 'GET /api/lots@@/{id}', 9, 12, 'One lot.', 'GET', '/api/lots@@/{id}', 'One', 'Lots@@', None, None, 'lots', None),
    (5, 'method', 'Count', 14, 14, '', None, None, None, 'Lots@@', None, None, None, None),
    (6, 'class', 'Rack@@', 2, 11, 'A rack.', None, None, None, None, None, None, None, None),
    (6, 'method', 'init', 3, 5, '', None, None, None, 'Rack@@', None, None, None, None),
    (6, 'method', 'put', 8, 10, 'Puts one.', None, None, None, 'Rack@@', None, None, None, None),
    (6, 'class', 'Rack@@', 13, 15, '', None, None, None, None, None, None, None, None),
    (6, 'method', 'size', 14, 14, '', None, None, None, 'Rack@@', None, None, None, None),
    (7, 'endpoint', 'GET /lots/@@', 2, 2, '', 'GET', '/lots/@@', None, None, None, None, None, None),
    (7, 'class', 'LotController@@', 5, 12, 'Lots of the store.', None, None, None, None, None, None, 'lots', None),
    (7, 'method', 'index', 8, 11, 'All lots.', None, None, None, 'LotController@@', None, None, 'lots', None),
    (7, 'function', 'helper@@', 14, 16, '', None, None, None, None, None, None, None, None),
    (8, 'function', 'pack_@@', 2, 4, 'Pack it.', None, None, None, None, None, None, None, None),
    (8, 'function', 'unpack_@@', 6, 8, '', None, None, None, None, None, None, None, None),
    (9, 'class', 'Shop@@', 2, 8, 'Shop things.', None, None, None, None, None, None, 'lots', None),
    (9, 'class', 'Lot', 3, 7, '', None, None, None, 'Shop@@', None, None, 'lots', None),
    (9, 'method', 'all', 4, 6, '', None, None, None, 'Lot', None, None, 'lots', None),
    (9, 'endpoint', 'RESOURCE /lots@@', 10, 10, '', 'RESOURCE', 'lots@@', None, None, None, None, None, None),
    (10, 'endpoint', 'ANY lots/@@/', 2, 2, '', 'ANY', 'lots/@@/', 'views.lots', None, None, None, None, None),
    (10, 'endpoint', 'ANY /any/@@', 8, 9, 'Any verb.', 'ANY', '/any/@@', 'anything', None, None, None, None, None),
    (11, 'function', 'function total_@@', 2, 3, 'Sum of a lot.', None, None, None, None, 'function', None, 'lots', None),
    (11, 'function', 'trigger touch_@@', 5, 6, '', None, None, None, None, 'trigger', None, None, None),
    (11, 'class', 'type state_@@', 8, 8, '', None, None, None, None, 'type', None, None, None),
    (12, 'page', 'Lots@@', 1, 5, '', None, None, None, None, None, '/lots/@@', None, '../lazy/@@|./store'),
    (12, 'page', 'Panel@@', 7, 11, '', None, None, None, None, None, '/panel/@@', None, None),
    (12, 'method', 'render', 8, 10, '', None, None, None, 'Panel@@', None, None, None, None),
    (12, 'component', 'App', 18, 20, '', None, None, None, None, None, None, None, None),
    (12, 'job', 'cron 0 1 * * *', 22, 24, '', None, None, None, None, None, None, None, None),
]


def found_sql() -> str:
    """DuckDB SQL for the units of all files."""
    def value(x: object) -> str:
        return "NULL" if x is None else str(x) if isinstance(x, int) else "'" + x.replace("'", "''") + "'"

    rows = ",\n ".join("(" + ", ".join(map(value, row)) + ")" for row in FOUND)
    ends = " ".join(f"WHEN {i} THEN '{e}'" for i, (e, _) in enumerate(SOURCES))
    filled = ", ".join(f if f.endswith("_line") else f"replace({f}, '@@', CAST(p_partkey AS varchar)) AS {f}"
                       for f in FIELDS)
    return f"""SELECT 'm' || p_partkey % 7 AS repo,
 'src/f' || p_partkey || '.' || CASE p_partkey % {len(SOURCES)} {ends} END AS file, {filled}
FROM part JOIN (VALUES {rows}) AS found(m, {", ".join(FIELDS)}) ON m = p_partkey % {len(SOURCES)}"""


def more_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """files(repo, path, text, size): a file per part, its language by the key."""
    part = spread(spark.read.parquet(f"{sf_dir}/part.parquet"))
    key, n = F.col("p_partkey").cast("string"), F.col("p_partkey") % len(SOURCES)
    source = F.get(F.array(*[F.lit(text) for _, text in SOURCES]), n.cast("int"))
    ends = F.get(F.array(*[F.lit(e) for e, _ in SOURCES]), n.cast("int"))
    files = part.select(
        F.concat(F.lit("m"), (F.col("p_partkey") % 7).cast("string")).alias("repo"),
        F.concat(F.lit("src/f"), key, F.lit("."), ends).alias("path"),
        F.replace(source, F.lit("@@"), key).alias("text"))
    return files.withColumn("size", F.octet_length("text").cast("bigint"))
