import pytest
from pyspark.sql import functions as F

from loomgraph.operators import analytics
from loomgraph.sources import code

FILES = {
    "app/(shop)/cart/page.tsx": "import { CartList } from '../../../src/CartList';\nimport Link from 'next/link';\n// <Fake />\nexport default function CartPage() {\n  return <div><CartList items={1} /><Link href=\"/orders/7\">x</Link></div>;\n}\n",
    "app/orders/[id]/page.tsx": "import Page from './View';\nexport default function OrderPage() { return <Page /> }\n",
    "app/orders/[id]/View.tsx": "export default function View() { const r = useRouter(); r.push('/cart?x=1'); return <p/>; }\n",
    "src/CartList.tsx": "import { useCart } from './useCart';\nimport * as x from 'lib';\nexport const CartList = () => {\n  const c = useCart();\n  fetch('/api/orders', { method: 'POST' });\n  api.get(`/items/${id}`);\n  return <CartList />;\n};\n",
    "src/useCart.ts": "import { CartCtx as C } from './ctx';\nexport function useCart() { return useContext(C); }\n",
    "src/ctx.ts": "export const CartCtx = createContext(null);\n",
    "app/api/orders/route.ts": "export async function POST() {}\n",
    "server/main.ts": "@Module({ imports: [DbModule.forRoot(1)], controllers: [OrdersController], providers: [OrdersService] })\nexport class AppModule {}\nasync function go() { app.setGlobalPrefix('v1'); }\n",
    "server/orders.controller.ts": "@Controller('orders')\nexport class OrdersController {\n  constructor(private readonly service: OrdersService) {}\n  @Get(':id') one() {}\n  @Post() add() {}\n}\n",
    "server/orders.service.ts": "@Injectable()\nexport class OrdersService {\n  constructor(@InjectRepository(Order) private readonly repo: Repository<Order>) {}\n}\n@Entity()\nexport class Order {}\n@Module({})\nexport class DbModule {}\n",
    "pubspec.yaml": "name: shop\n",
    "lib/main.dart": "import 'package:shop/home.dart';\nimport 'package:other/x.dart';\nfinal routes = { '/home': (c) => const Home(), };\nconst CH = 'shop/pay';\nclass App extends StatelessWidget {\n  build() { return Home(); }\n}\nfinal cartProvider = StateNotifierProvider<Cart>((r) => Cart());\n",
    "lib/home.dart": "class Home extends StatefulWidget {}\nclass _HomeState extends State<Home> {\n  final ch = MethodChannel('shop/pay');\n  go() { Navigator.pushNamed(context, '/home'); http.post(Uri.parse('https://h/pay?x')); ref.watch(cartProvider); }\n}\nclass Cart extends StateNotifier {}\n",
    "android/app/Main.kt": "val NAME = \"shop/pay\"\nMethodChannel(engine, NAME).set()\nMethodChannel(engine, \"shop/unused\")\n",
    "node_modules/x/index.ts": "export const Bad = 1;\n",
    ".cache/y.ts": "export const Bad = 1;\n",
}


@pytest.fixture(scope="module")
def graph(spark, tmp_path_factory):
    root = tmp_path_factory.mktemp("project")
    for path, text in FILES.items():
        (root / path).parent.mkdir(parents=True, exist_ok=True)
        (root / path).write_text(text)
    files = code.discover(spark, str(root)).cache()
    assert {r["path"] for r in files.collect()} == {p for p in FILES if not p.startswith(("node_modules", "."))}
    found = code.index_project(files)
    return {r["id"]: r for r in found.nodes.collect()}, {(r["src"], r["kind"], r["dst"]): r for r in found.edges.collect()}, found


def test_frontend(graph):
    nodes, edges, _ = graph
    for edge in [
        ("app/(shop)/cart/page.tsx#CartPage", "renders", "src/CartList.tsx#CartList"), ("route:/cart", "routes_to", "app/(shop)/cart/page.tsx#CartPage"),
        ("app/(shop)/cart/page.tsx#CartPage", "navigates_to", "route:/orders/:id"), ("app/orders/[id]/page.tsx#OrderPage", "renders", "app/orders/[id]/View.tsx#View"),
        ("app/orders/[id]/View.tsx#View", "navigates_to", "route:/cart"), ("src/CartList.tsx#CartList", "uses", "src/useCart.ts#useCart"), ("src/useCart.ts#useCart", "uses", "src/ctx.ts#CartCtx"),
        ("src/CartList.tsx#CartList", "calls", "api:POST /api/orders"), ("src/CartList.tsx#CartList", "calls", "api:GET /items/:param"), ("src/CartList.tsx", "imports", "src/useCart.ts"), ("src/ctx.ts", "defines", "src/ctx.ts#CartCtx"),
    ]:
        assert edge in edges, edge
    assert edges["app/(shop)/cart/page.tsx#CartPage", "navigates_to", "route:/orders/:id"]["confidence"] == 0.8
    assert nodes["api:ROUTE /api/orders"]["declared"] and nodes["src/ctx.ts#CartCtx"]["type"] == "context" and not any("Fake" in x or "Bad" in x for x in nodes)


def test_nestjs(graph):
    nodes, edges, _ = graph
    for edge in [
        ("api:GET /v1/orders/:id", "routes_to", "server/orders.controller.ts#OrdersController"), ("api:POST /v1/orders", "routes_to", "server/orders.controller.ts#OrdersController"),
        ("server/orders.controller.ts#OrdersController", "injects", "server/orders.service.ts#OrdersService"), ("server/orders.service.ts#OrdersService", "uses", "server/orders.service.ts#Order"),
        ("server/main.ts#AppModule", "contains", "server/orders.controller.ts#OrdersController"), ("server/main.ts#AppModule", "imports", "server/orders.service.ts#DbModule"),
    ]:
        assert edge in edges, edge
    assert nodes["server/orders.service.ts#Order"]["role"] == "data-model"


def test_dart_and_native(graph):
    nodes, edges, found = graph
    for edge in [
        ("lib/main.dart#App", "renders", "lib/home.dart#Home"), ("route:/home", "routes_to", "lib/home.dart#Home"), ("lib/home.dart#Home", "navigates_to", "route:/home"), ("lib/home.dart#Home", "calls", "api:POST /pay"),
        ("lib/home.dart#Home", "invokes", "channel:shop/pay"), ("android/app/Main.kt", "handles", "channel:shop/pay"), ("lib/main.dart", "imports", "lib/home.dart"), ("lib/home.dart#Home", "uses", "lib/main.dart#cartProvider"),
    ]:
        assert edge in edges, edge
    assert nodes["lib/home.dart#Home"]["loc"] == 1 and nodes["lib/home.dart#Cart"]["type"] == "context"
    assert [tuple(r) for r in analytics.channel_gaps(found).collect()] == [("channel:shop/unused", "orphan")]


def test_comments():
    text = "a // x\n'// kept' /* b\nc */ d"
    assert code.strip_comments(text) == "a     \n'// kept'     \n     d"


MORE = {
    "pubspec.yaml": "name: app\n",
    "lib/router.dart": "import 'package:app/pages.dart';\nfinal router = GoRouter(routes: [GoRoute(path: '/', builder: (c, s) => const HomePage()), GoRoute(\n  name: 'item', path: 'item/:id', pageBuilder: (c, s) { return MaterialPage(child: ItemPage(s)); })]);\nfinal table = <String, WidgetBuilder>{'/help': (ctx) => HelpPage(title: 'x')};\n",
    "lib/pages.dart": "class HomePage extends ConsumerWidget { build(c, ref) { context.go('/item/3?q=1'); return Column(children: [ItemPage.small(1), Text(\"// not HelpPage(\")]); } }\n"
    "class ItemPage extends HookWidget { f() { final s = BlocProvider.of<CartBloc>(context); Navigator.of(context).pushNamed('/help'); _dio.get<Map<String, int>>('/v1/items', queryParameters: {'a': 1}); } }\n"
    "class HelpPage extends StatelessWidget { final a = EventChannel(kName); final b = Provider.of<Missing>(context); }\nconst String kName = 'app/events';\nclass CartBloc extends Bloc<E, S> {}\nclass MaterialPage extends StatelessWidget {}\n",
    "ios/Runner/App.swift": 'let name: String = "app/events"\nlet c = FlutterEventChannel(name: name, binaryMessenger: m)\nlet d = FlutterMethodChannel(name: "app/only", binaryMessenger: m)\n',
    "ios/Runner/App.m": '// methodChannelWithName:@"no"\nFlutterMethodChannel* c = [FlutterMethodChannel methodChannelWithName:@"app/objc" binaryMessenger:x];\n',
    "android/A.java": 'static final String X = "app/java";\nnew MethodChannel(engine.getDartExecutor().getBinaryMessenger(), Names.X).setHandler(h);\n',
}


def test_facts_of_dart_and_native_syntax(spark):
    files = spark.createDataFrame(list(MORE.items()), "path string, content string").withColumn("hash", F.sha1("content")).cache()
    dart, native = code.dart(files), code.native(files)
    edges = {(r["src"], r["kind"], r["dst"]) for g in (dart, native) for r in g.edges.collect()}
    for edge in [
        ("route:/", "routes_to", "lib/pages.dart#HomePage"), ("route:/help", "routes_to", "lib/pages.dart#HelpPage"), ("lib/pages.dart#HomePage", "navigates_to", "route:/item/:id"), ("lib/pages.dart#ItemPage", "navigates_to", "route:/help"),
        ("lib/pages.dart#HomePage", "renders", "lib/pages.dart#ItemPage"), ("lib/pages.dart#ItemPage", "uses", "lib/pages.dart#CartBloc"), ("lib/pages.dart#ItemPage", "calls", "api:GET /v1/items"), ("lib/router.dart", "imports", "lib/pages.dart"),
        ("lib/pages.dart#HelpPage", "invokes", "channel:app/events"), ("ios/Runner/App.swift", "handles", "channel:app/events"), ("ios/Runner/App.swift", "handles", "channel:app/only"), ("ios/Runner/App.m", "handles", "channel:app/objc"), ("android/A.java", "handles", "channel:app/java"),
    ]:
        assert edge in edges, edge
    assert ("lib/pages.dart#HomePage", "renders", "lib/pages.dart#HelpPage") not in edges and not any(e[2] == "channel:no" for e in edges)


def test_broken_and_long_texts_have_facts_in_time():
    import time

    began = time.time()
    for text in ("(" * 20_000, "f(" * 20_000, "a.b<" * 20_000 + ">(", "x = 'y', " * 20_000, "", "class", "'open", "f(" * 400 + ")" * 400):
        list(code.Tokens(text).facts())
    assert time.time() - began < 10


def test_a_limit_of_files_warns(spark):
    files = spark.createDataFrame([(f"lib/{i}.dart", "") for i in range(5)], "path string, content string")
    assert code.files_of(files, "dart").count() == 5
    with pytest.warns(UserWarning, match="dart: 3 files"):
        assert [r["path"] for r in code.files_of(files, "dart", 2).collect()] == ["lib/0.dart", "lib/1.dart"]


def test_many_alike_files_are_matched_in_many_tasks(spark, tmp_path):
    """In a table they are so small that it would be read in one task."""
    page = "export default function Page() {}\n" * 40
    spark.range(5000).selectExpr("concat('app/p', id, '/page.tsx') AS path", f"'{page}'".replace("\n", "\\n") + " AS content").coalesce(1).write.parquet(f"{tmp_path}/files")
    files = spark.read.parquet(f"{tmp_path}/files")
    assert files.rdd.getNumPartitions() == 1
    sizes = code.dealt(files).rdd.mapPartitions(lambda rows: [sum(1 for _ in rows)]).collect()
    assert sum(sizes) == 5000 and len(sizes) >= 3 and max(sizes) < code.FILES_A_TASK * 1.2
    assert code.scan(files, "frontend").where("rule = 'default'").count() == 5000 * 40
