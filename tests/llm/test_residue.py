import pytest

from kithloom.llm import residue as R

PLACEHOLDERS = [
    "Dear {{ first_name }},", "Price: {price} per person", "Willkommen, %NAME%!", "Call us on <%= phone %>.", "Ihr Termin: ${event.start}", "Hello [[+user_name]]!",
    "Posted on #{date}", "Only %s left in stock.", "Copyright __YEAR__ the society", "*|FNAME|*, your order", "Prix : {{{price}}}", "&lt;opening_hours&gt;", "[insert page title here]",
    "Welcome back, undefined!", "[object Object]", "undefined", "Hola, {0}:", "残り{{ stock | upper }}席です。", "<?php echo $title; ?>", "%(city)s", "@@phone@@", "##ORDER##", "~~author~~",
    "{!! $body !!}", "[PRODUCT NAME]", "$order_id$", "{% title %}", "Real text about the harbour.\n\nOpening hours: {{hours}}\n\nMore real text.", "Total: undefined per person",
    "{{​name}}",
]
MENTIONS = [
    "To print a value, write {{ name }} in the template; the engine replaces it.", "Use `{{ name }}` here.", 'The form "{{ name }}" is old.', "escape it as \\{{ name }}.",
    "f(x) = {1, 2, ..., n} and f: {0, 1} → {1}", "Let A = {b, c} and B = {{b}, {c}}.", "The interval [n, b] contains [[n]].", "Then $k$ denotes the size.", "The value at 0 stays undefined.",
    "a/0 is undefined, a%2 is not.", "20% of $5 left", "for (i = 0; i < 9; i++) { total += box[i]; }", "An undefined index is an error in code.", "[PDF] and [SIC]", "The tag {{ a_b }} is deprecated.",
    "C'est un gabarit : {{ nom }} y est remplacé.", "<| end of text |>", "x_{10} and g^{ab}", "100% sure", "",
]


@pytest.mark.parametrize("text", PLACEHOLDERS)
def test_unfilled(text):
    assert R.verdict(text) == "placeholder"


@pytest.mark.parametrize("text", MENTIONS)
def test_mentioned(text):
    assert R.placeholder(text) is None


EMPTY = [
    "404 - Not Found\nThe page you requested may have moved.\nTry the search instead.", "Home | News | Contact\n\nACCESS DENIED\n\n© 2011 Somewhere",
    "We use cookies. Accept all | Settings\nPlease enable JavaScript to continue.", "Lorem ipsum dolor sit amet, consectetur adipiscing elit", "asdf qwertz test xxx",
    "Seite\nnicht\ngefunden", "Your title goes here.\nSample text. Edit me.", "Página não encontrada", "PÃ¡gina nÃ£o encontrada", "拒绝访问", "ただいまメンテナンス中です。", "페이지를 찾을 수 없습니다.",
    "Доступ запрещён", "Sayfa bulunamadı", "SUNUCU HATASI", "Choir of Somewhere\nWe are down for maintenance.", "Traceback (most recent call last): File \"/app/serve.py\", line 7",
    "Fatal error: Uncaught exception in /srv/lib/view.php on line 12", "500 Internal Server Error\nIncident d0d1bb-b0da", "Loading... If nothing happens, make sure JS can run.",
    "Ac­cess de​nied", "Access denied", "Go\nback\nto the start page. Page not found", "Η σελίδα δεν βρέθηκε",
]
REAL = [
    "Hollum bakery\nRehearsal on Friday.", "Choir\nTel. 50932", "Sold out.", "Page not found: why the new archive has gaps, and what the council does about them.",
    'On Tuesday readers saw the message "internal server error" for an hour.', "Noscript fallback\nThe children learn what JavaScript is.", "The missing page of the diary could not be found.",
    "Auf dem Schirm stand „Bitte aktivieren Sie JavaScript in Ihrem Browser.“, sagt der Verein.", "Please enable JavaScript to continue.\n" + "The mill was repaired in spring and opened again by the council. " * 3,
    "Villa annus mane ad forum. Per hortus aqua villa parvus.", "Home | News | Contact", "© 2020 Somewhere", "We use cookies. OK", "test", "a", "   ", "\n\n", "", None,
    "Bakery\nWe moved to the mill. See you there!\nPlease enable JavaScript.", "The road is temporarily closed for maintenance, walkers may pass.",
]


@pytest.mark.parametrize("text", EMPTY)
def test_nothing_but_messages(text):
    assert R.verdict(text) == "residue"


@pytest.mark.parametrize("text", REAL)
def test_real_pages(text):
    assert R.verdict(text) is None


@pytest.mark.parametrize(
    "text",
    ["Dear <your name>, your order left the harbour.", "Call us on (insert phone here).", "Signed (your full name)", "Open (add opening hours)", "News of [TOPIC]", "The [NEWSLETTER NAME] of May", "[PHOTO CAPTION]", "[EDITOR NAME]", "[SOURCE NAME]"],
)
def test_unfilled_in_any_brackets(text):
    assert R.verdict(text) == "placeholder"


@pytest.mark.parametrize("text", ["Stir (add two eggs) and wait.", "The hall (enter from the mill) is open.", "Take a coat (your own will do).", "[UPDATED] [EDITED] [CITATION NEEDED] [BACK TO TOP]", "[NEXT PAGE] [NEWS] [PHOTOS]"])
def test_said_in_brackets(text):
    assert R.verdict(text) is None


@pytest.mark.parametrize("charset", ["latin-1", "browser"])
@pytest.mark.parametrize("text", ["Страница не найдена", "您访问的页面不存在", "ページが見つかりません", "페이지를 찾을 수 없습니다", "الصفحة غير موجودة", "Nie znaleziono strony. Błąd wewnętrzny serwera", "Sayfa bulunamadı", "Η σελίδα δεν βρέθηκε"])
def test_garbled_messages(text, charset):
    read = {"latin-1": lambda b: b.decode("latin-1"), "browser": lambda b: "".join(bytes([x]).decode("cp1252", "ignore") or chr(x) for x in b)}[charset]
    assert R.verdict(read(text.encode())) == "residue"
    assert R.verdict("Home | News\r\n" + read(text.encode()) + "\r\n© 2011 Çeşme") == "residue"


@pytest.mark.parametrize("text", ["Ça et là, où l'été naît", "Ärger über Öl", "ÃÂ", "Smørrebrød på Ærø"])
def test_texts_that_are_not_garbled_stay(text):
    assert R._repaired(text) == text


@pytest.mark.parametrize(
    "text",
    ["Enable JavaScript and cookies to continue", "Home | News Page not found. We use cookies. OK", "Please enable cookies and JavaScript.", "This site requires JavaScript and cookies.",
     "Page not found\nWe value your privacy. We use cookies to improve this site. By browsing on you agree. OK", "Access denied. This site uses cookies. Accept all | Settings"],
)
def test_messages_beside_cookies(text):
    assert R.verdict(text) == "residue"


@pytest.mark.parametrize("text", ["The mill was repaired in spring. We use cookies. OK\nPlease enable JavaScript.", "We use cookies to run this site. Got it", "We value your privacy. We use cookies. Accept"])
def test_no_messages_beside_cookies(text):
    assert R.verdict(text) is None


def test_long_text_is_read_whole():
    assert R.verdict("The mill was repaired. " * 60_000 + "Opening hours: {{ hours }}") == "placeholder"
    assert R.verdict("Page not found. " * 60_000) == "residue"
    assert R.verdict("word" * 300_000) is None


def test_frames(frame):
    rows = [(1, "Access denied", "clash"), (1, "Access denied", ""), (2, None, ""), (3, "", ""), (None, "{{ name }}", ""), (4, "The mill was repaired.", "")]
    df = frame(rows, "doc_id long, text string, verdict string")
    got = sorted((r.doc_id or 0, r.verdict or "") for r in R.judge(df, "doc_id", "text").collect())
    assert got == [(0, "placeholder"), (1, "residue"), (1, "residue"), (2, ""), (3, ""), (4, "")]
    assert R.judge(df.limit(0), "doc_id", "text").count() == 0


def test_bytes_that_are_no_text(spark):
    rows = spark.sql("SELECT 1L AS doc_id, concat(cast(unhex('FFFE') AS string), ' Dear {{ name }}') AS text UNION ALL SELECT 2L, cast(unhex('FFFE') AS string)")
    assert {r.doc_id: r.verdict for r in R.judge(rows, "doc_id", "text").collect()} == {1: "placeholder", 2: None}
