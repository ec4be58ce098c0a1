"""Small inputs in Japanese, as the shared tables hold none, with what is expected of them.

The expected values are fixed values: what these readings, decodings and matches have to be.
"""

DICTIONARY_LINES = [
    ";; okuri-ari entries.", "げんt /現/", ";; okuri-nasi entries.", "; a comment", "", "げん /現/言/減;発生-/源/元/", "げんご /言語/原語;original language/",
    "じんじ /人事/", "かんり /管理/", "けん /件/", "けんきゅう /研究/", "こと /言/事/", "nokana /無/", "しるし /#印/;only/印;mark/",
]
DICTIONARY = {
    "現": "ge,n", "言": "ge,n", "減": "ge,n", "源": "ge,n", "元": "ge,n", "言語": "ge,n,go", "原語": "ge,n,go", "人事": "ji,n,ji",
    "管理": "ka,n,ri", "件": "ke,n", "研究": "ke,n,kyu,u", "事": "ko,to", "印": "shi,ru,shi",
}

KANA = {
    "げんご": "ge,n,go", "がっこう": "ga,kko,u", "そーすこーど": "so,o,su,ko,o,do", "ソースコード": "so,o,su,ko,o,do", "まっちゃ": "ma,ccha",
    "パーティー": "pa,a,ti,i", "プロ・グラム": "pu,ro,gu,ra,mu", "っな": "nna", "っ": "", "ーあ": "a", "": "",
}
QUERIES = {
    "gengo": "ge,n,go", "geng": "ge,n", "gen": "ge,n", "si": "shi", "ti": "chi", "kanri": "ka,n,ri", "gakkou": "ga,kko,u", "maccha": "ma,ccha",
    "matcha": "ma", "kinyou": "ki,nyo,u", "github": "gi", "gitkanri": "gi", "test": "te", "GEN": "ge,n", "": "",
}
RUNS = {"言語": "言語", "言": "言", "管理人事": "管理|人事", "未知": "", "研究会": "研究", "未言語件": "言語|件", "言語研究言": "言語|研究|言"}
#: (text, query, path, start, score, highlight)
MATCHES = [
    ("言語", "gen", "mora", 0, 203, "0,1"), ("言語", "gengo", "mora", 0, 303, "0,1"), ("人事", "jin", "mora", 0, 203, "0,1"),
    ("プロジェクト管理", "kanri", "mora", 5, 303, "6,7"), ("プログラム", "rogu", "mora", 1, 204, "1,2"), ("プログラム", "ogu", None, None, None, ""),
    ("GitHub", "git", "plain", 0, 306, "0,1,2"), ("研究会", "kenkyuu", "mora", 0, 404, "0,1"), ("鰯", "iwashi", None, None, None, ""),
    ("test.txt", "te", "plain", 0, 208, "0,1"), ("テスト.txt", "te", "mora", 0, 107, "0"), ("test.txt", "test", "plain", 0, 408, "0,1,2,3"),
    ("テスト.txt", "test", "mora", 0, 107, "0"), ("アプリ", "ap", "mora", 0, 103, "0"), ("GitHub - ソースコード管理", "kanri", "mora", 15, 303, "15,16"),
    ("GitHub - ソースコード管理", "gitkanri", None, None, None, ""), ("ギター", "github", "mora", 0, 103, "0"), ("プロ・グラム", "rogu", "mora", 1, 204, "1,3"),
    ("がっこう", "gakkou", "mora", 0, 303, "0,1,2,3"), ("パーティー", "pati", None, None, None, ""), ("きんよう", "kinyou", None, None, None, ""),
    ("radio", "io", "mora", 3, 202, "3,4"), ("radio", "dio", "plain", 2, 303, "2,3,4"), ("radio", "", None, None, None, ""),
]
LISTING = [("zeta", True), ("alpha", True), ("readme.txt", False), ("アプリ", True), ("Documents", True), ("apple.txt", False), ("app", True), ("test.txt", False), ("テスト.txt", False)]
TOKENS = [("Documents/ap", "Documents/", "ap"), ("ap", "", "ap"), ("a/b/c", "a/b/", "c"), ("Documents\\ap", "Documents\\", "ap"), ("", "", "")]
CANDIDATES = [("Documents/", "アプリ", True, "Documents/アプリ/"), ("", "notes.txt", False, "notes.txt")]
ADDRESSES = [
    ("https://a.com/x?y=1", "", "a.com"), ("https://a.com?x=1", "", "a.com"), ("https://a.com?x=/y", "", "a.com?x="), ("https://a.com", "", "a.com"),
    ("a.com/x", "", "a.com/x"), ("https://a.com/x", "Home", "Home"),
]
#: Queries against English titles: vowels match by units, all others by substring.
ASKED = ["io", "ai", "on", "the", "ner", "THE", "tre", "", None, "the", "zzzz"]
STORE_FILE = """[[bookmarks]]
type = "bookmark"
title = "Home"
url = "https://a.com"
access_count = 2
[[bookmarks]]
type = "app"
title = "Run"
command = "run"
args = ["-a", "b"]
"""
STORE_ROWS = [(0, "bookmark", "Home", "https://a.com", None, None, 2), (1, "app", "Run", None, "run", "-a,b", 0)]
LABELS = [
    ("fuzzy", "Fuzzy"), ("fuzzy", "Fuzzy"), ("reading", "Reading"), ("reading", "Reading (dict missing)"), ("combined", "Combined"), ("combined", "Combined (dict missing)"),
    ("by_score", "Score"), ("by_count", "Count"),
]
SHOWN = [(0, ["a", "b"], "   0 ", " a b"), (12345, [], "12345 ", ""), (77, ["x"], "  77 ", " x")]
ADDRESS_LIKE = [("a.b", 0, True), ("a.b", 1, False), (" ", 0, False), ("http://x", 0, True), ("  https://x ", 0, True), ("word", 0, False), ("", 0, False)]
TITLES = [
    ("<title> a &amp; b </title>", "a & b"), ("<TITLE lang=x>It&#8217;s &mdash; caf&eacute;</TITLE >", "It\u2019s \u2014 caf\u00e9"), ("<!-- <title>no</title> --><title>yes</title>", "yes"),
    ("<script>x = '<title>no</title>'</script><title>yes</title><title>two</title>", "yes"), ("<title>open", "open"), ("<p>none</p>", ""), ("<title></title>", ""),
    ("<title>a <!-- b --> c</title>", "a <!-- b --> c"), ("<title>&amp;amp; &lt;p&gt; &#x80; &unknown; &copy 2</title>", "&amp; <p> \u20ac &unknown; \u00a9 2"),
]
