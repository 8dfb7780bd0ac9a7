"""Template residue and pages without content: unfilled placeholders, filler, error messages, demands for scripts.

Two findings exclude a text:

placeholder: a template's placeholder stands where a value belongs. Mentions don't count: a placeholder that is quoted, escaped
  or set as code, one in a sentence about templates, and what mathematics and source code write alike.

residue: menus, cookie notices, footers and titles aside, the text is nothing but known messages. A multi-pattern automaton
  finds the phrases of many languages, the part of the remaining letters and digits that they cover decides. Pages that
  explain, quote or report such messages hold more than them, as do real pages with a notice besides their content.
"""

from __future__ import annotations

import html
import re
import unicodedata
from collections.abc import Iterator
from functools import lru_cache
from itertools import product

import ahocorasick
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, functions as F, types as T

#: Part of a text's remaining letters and digits that messages must cover.
COVERED = 0.9
#: Part that messages must cover by themselves, without the words beside them.
SAID = 0.25
#: Title-like lines that are no content, and the most words of such a line.
TITLES, TITLE_WORDS = 2, 6

# --- fixed values: what stands for a placeholder ------------------------------------------------------------------------

#: A letter, digit or mark of any script.
_C = r"[\w\u0300-\u036f\u064b-\u0655\u0900-\u0dff\u0e31-\u0e4e]"
_NAME = rf"[^\W\d_]{_C}*(?:[_.\-]{_C}+)*"
_UPPER = r"[A-Z][A-Z0-9]+(?:[_.][A-Z0-9]+)*"
#: A name with what template languages let follow it: members, places, calls, filters.
_EXPR = rf"[$@]?{_NAME}(?:\??\.{_C}+|\[[^\]{{}}\n]{{0,20}}\]|\([^(){{}}\n]{{0,40}}\)|->{_C}+)*(?: ?\|\|? ?[^{{}}\n]{{1,60}}?)?"
_BLOCK = r"(?:if|unless|each|for|foreach|with|else|elseif|include|block|endif|endfor|endblock)\b[^{}%\n]{0,60}"
_PROMPT = r"(?i:insert|enter|your|add)"
#: The placeholder signs of template languages, mail merges and string formats that mean nothing else.
CERTAIN = (
    rf"<\?(?:php|=)(?: echo)? ?{_EXPR} ?;? ?\?>",
    rf"<%[=-]? ?{_EXPR}(?: :?{_C}+)* ?-?%>",
    rf"\{{!! ?\$?{_NAME} ?!!\}}",
    rf"\{{!\$?{_NAME}\}}",
    rf"\{{\{{\{{ ?{_NAME} ?\}}\}}\}}",
    rf"\{{\{{[#/&^>~-]? ?(?:{_BLOCK}|{_EXPR}) ?\}}\}}",
    r"\{\{ ?\d+ ?\}\}",
    rf"\{{%-? ?(?:{_BLOCK}|{_NAME}) ?-?%\}}",
    rf"[$#@]\{{ ?{_EXPR} ?\}}",
    rf"\{{\${_NAME}\}}",
    rf"%\({_NAME}\)[sd]",
    rf"%%{_NAME}%%",
    rf"%{_UPPER}%",
    r"%[a-z]+(?:[_.][a-z]+)+%",
    r"(?<![\w%])%[sd](?!\w)",
    rf"__{_UPPER}__",
    rf"@@{_NAME}@@",
    rf"##{_UPPER}##",
    rf"\[\[[+*~$]{_NAME}\]\]",
    rf"\*\|{_UPPER}\|\*",
    rf"[\[<{{]{_PROMPT}[ _][\w ]{{2,40}}(?:[ _]here)?[\]>}}]",
    # in round brackets only what can't be said in passing, as "(add two eggs)" and "(enter from the mill)" are
    r"\((?:insert[ _][\w ]{2,40}|(?:enter|your|add)[ _](?:[\w ]{1,40}[ _]here|(?:(?:your|the|an?)[ _])?(?:[A-Za-z]+[ _])?(?:name|surname|e?mail|address|phone|telephone|number|date|hours"
    r"|price|title|subject|city|town|company|url|link|text|message|username|password|signature)))\)",
    r"\[object Object\]",
    r"(?<![→=∈⊂∪∩] )(?<![\w$#@^_\\{]){\d}(?!\})",
    r"\bundefined\b",
)
#: Signs that are also wiki links, emphasis, formulas, markup or stage directions; placeholders if they hold a field's name.
IF_FIELD = (
    rf"\${_NAME}\$",
    rf"\[\[{_NAME}\]\]",
    rf"~~{_NAME}~~",
    rf"&lt;{_NAME}&gt;",
    rf"<<{_NAME}>>",
    rf"\[{_NAME}(?:[ _]{_NAME}){{0,4}}\]",
    rf"(?<![A-Za-z0-9_$#@^\\{{]){{{_NAME}}}(?!\}})",
    rf"(?<=(?:err|rau|ear|eur|ame|llo|iss|mrs|ola|ado|ber|ebe) )«{_NAME}»",
)
#: What the fields of letters, shops and pages are called.
FIELDS = """name names firstname lastname fullname surname forename username nickname title subtitle headline subject topic date day month year time hour hours price prices cost amount total
count number quantity qty address street city town country zip postcode phone telephone mobile email mail url link website company organisation organization product item order user customer client
recipient author message text content description summary caption event venue location place currency discount language category department signature salutation deadline logo password code slogan locale timezone region slug version status id stock
vorname nachname anrede datum uhrzeit preis betrag anzahl nummer adresse straße ort stadt telefon firma titel betreff termin jahr monat kunde öffnungszeiten
nom prénom heure prix montant ville téléphone société titre sujet mois année auteur nombre apellido apellidos fecha hora precio importe dirección ciudad teléfono empresa título asunto mes año autor
nome sobrenome cognome preço prezzo endereço indirizzo cidade città titolo naam voornaam achternaam tijd prijs adres imię nazwisko godzina cena miasto tytuł isim soyad tarih saat fiyat şehir
имя фамилия дата время цена адрес город телефон название автор 姓名 名字 日期 时间 价格 地址 城市 电话 标题 名前 氏名 価格 住所 件名 이름 날짜 시간 가격 주소 제목"""
#: Labels that pages set in brackets themselves.
LABELS = re.compile(
    r"\[(?:PDF|SIC|EDIT(?:ED)?|SOURCES?(?:[ _]NEEDED)?|VIDEOS?|AUDIO|PHOTOS?|MAPS?|NEWS?|DELETED|REDACTED|REMOVED|CITATIONS?(?:[ _]NEEDED)?|UPDATED?|TOP(?:[ _]OF[ _]PAGE)?"
    r"|BACK(?:[ _]TO[ _]TOP)?|NEXT(?:[ _]PAGE)?|PREV(?:IOUS)?(?:[ _]PAGE)?|SPOILERS?(?:[ _](?:ALERT|WARNING))?)\]",
    re.I,
)
#: What stands before or behind a value in letters and on pages of shops and clubs; a colon doesn't count before square brackets, which transcripts use.
VALUE_AFTER = re.compile(
    r"(?:\b(?:dear|hello|hi|hey|welcome(?: back)?|good (?:morning|evening)|only|call us (?:on|at)|(?:reach|write to|mail) us at|(?:posted|published|written) (?:on|by)|your (?:order|booking|ticket|code)"
    r"|hallo|guten tag|willkommen(?: zurück)?|liebe[rs]?|sehr geehrte\S*(?: \w+)?|nur noch|ihre (?:bestellung|buchung)|bonjour|bienvenue|chère?|(?:madame|monsieur)|votre (?:commande|réservation)|il ne reste que"
    r"|hola|bienvenid[oa]s?|estimad[oa]s?|su (?:pedido|reserva)|quedan|olá|bem-vind[oa]|prezad[oa]|seu pedido|ciao|gentile|benvenut[oa]|il tuo ordine|beste|geachte|uw bestelling|witaj|szanown[yai]+"
    r"|здравствуйте|уважаем\w+|добро пожаловать|ваш заказ|осталось|merhaba|sayın)[,، ]{1,2}|残り|尊敬的|您好[,，]?)$",
    re.I,
)
VALUE_BEFORE = re.compile(r"^(?:様|さん|先生|女士|님| left\b| per (?:person|night|month|day)\b| (?:auf lager|en stock|pro person|par personne|por persona)\b)", re.I)
#: What transcripts, news and boards set in capitals and brackets; other words of six letters or more there are fields.
DIRECTIONS = frozenset(
    "and applause laughter laughs laughing music playing cheers cheering clapping silence pause inaudible unintelligible indistinct crosstalk whispers whispering screams screaming crying sobbing coughs coughing"
    " sighs sighing gasps chuckles shouting singing ringing knocking barking thunder background noise chatter foreign speaking speaks language continues begins resumes stops censored exclusive breaking opinion"
    " advertisement sponsored promoted repost solved closed locked pinned archived spoiler warning announcement discussion question answered request update official confirmed explicit remastered instrumental"
    " translated translation transcript english german french spanish italian russian chinese japanese korean arabic".split()
)
#: Elements of HTML, which pages write about, but for those that are also called like fields.
TAGS = frozenset(
    "a abbr area article aside audio b base blockquote body br button canvas cite col data dd del details dialog div dl dt em embed fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6"
    " head header hr html i iframe img input ins kbd legend li main map mark menu meta nav noscript object ol option p param picture pre progress q s samp script section select small source span"
    " strong style sub sup svg table tbody td template textarea tfoot th thead tr track u ul var video".split()
)
_PLACEHOLDER = re.compile("|".join(f"(?:{p})" for p in CERTAIN) + "|(?P<open>" + "|".join(f"(?:{p})" for p in IF_FIELD) + ")")
#: One of these is in every text with a placeholder.
_SIGNS = re.compile(rf"[{{\[%$@#~_«]|\*\||&lt;|<[%?<]|[<(]{_PROMPT}[ _]|undefined")
#: Words of sentences about placeholders, in which they are a subject.
ABOUT = re.compile(
    r"\b(?:templates?|templating|jinja\d?|mustache|handlebars|liquid|twig|smarty|freemarker|thymeleaf|syntax|deprecated|escaped?|escaping|dialects?|html\d?|placeholders?|(?-i:tags?)|engines?|layout files?|data files?|swapped|replaced"
    r"|substitut\w+|interpolat\w+|denotes?|loops?|rendered|renderer|compil\w+|parser|markup|source code|run the build|answer: put|for example|such as"
    r"|vorlagen?|platzhalter|syntax|veraltet|schablonen?|gabarits?|syntaxe|obsol\w+|balises?|plantillas?|sintaxis|etiquetas?|marcador\w*"
    r"|modell[oi]|sintassi|segnaposto|modelos?|sintaxe|szablon\w*|składni\w*|sjablo\w+|syntaxis)\b|шаблон|синтаксис|заполнител|模板|占位符|语法|テンプレート|プレースホルダ|構文",
    re.I,
)
#: A set or tuple with a comma, an arrow or a quotient: mathematics.
_MATH = re.compile(r"\{[^{}\n]{0,40},[^{}\n]{0,60}\}|→|\b\w\(\w\) ?=|\b\w/0\b|\bfor \(|;\s*\w+\+\+")
_PREDICATE = re.compile(
    r"\b(?:is|are|was|were|be|been|being|stays?|stayed|remains?|remained|left|leaves?|becomes?|became|still|called|as|an|of|into)\s+(?:mathematically\s+|then\s+|also\s+)?$", re.I
)
_CLOSED = re.compile(r"\s*(?:$|[^\w\s]|(?:for|at|in|when|if|on|by|here|there|and|or|but|because|as|until|unless|where|while|so|over|outside|within|before|after|since|then|under|without)\b)", re.I)
#: "an undefined period": an adjective.
_ATTRIBUTE = re.compile(r"\b(?:an?|the|this|that|these|those|some|any|such|no|its|their|his|her|our|\w{3,}ly)\s+$", re.I)
_CODE = re.compile(r"\b[sf]?printf\s?\(|\bformat\s?\(|console\.log|\becho \"|\bimport \w+|\breturn [\w\"]", re.I)
_NOUN = re.compile(r"^\s+(?:index|variable|function|method|property|offset|constant|reference|behaviou?r|values?|terms?|symbols?|array|key|slope|form|expression|operation|class|identifier)\b", re.I)
_OPEN, _CLOSE = "`\"'“”„«»‹›‘’\\", "`\"'“”„«»‹›‘’"
_SENTENCE = re.compile(r"\n+|(?<=[.!?…;])\s+(?=[\"“„«¿¡]?[^\W\d_a-zà-ÿа-я])|(?<=[。！？])")

# --- fixed values: messages -----------------------------------------------------------------------------------------------

#: What menus of pages are made of.
MENUS = """home|start|start page|about|about us|contact|contact us|news|archive|search|login|log in|sign in|sign up|register|imprint|sitemap|shop|help|faq
calendar|privacy|privacy policy|terms|legal|legal notice|menu|blog|events|gallery|careers|jobs|support|more|back|next|previous|top|skip to content
startseite|über uns|kontakt|impressum|datenschutz|anmelden|suche|termine|archiv|hilfe|neuigkeiten|aktuelles|agb|warenkorb|menü
accueil|à propos|contact|recherche|connexion|mentions légales|agenda|archives|aide|actualités|boutique|plan du site
inicio|quiénes somos|contacto|buscar|entrar|aviso legal|archivo|agenda|ayuda|noticias|tienda|mapa del sitio
главная|о нас|контакты|поиск|вход|архив|новости|помощь|магазин|карта сайта
home page|chi siamo|contatti|cerca|accedi|archivio|note legali|notizie|aiuto|início|sobre nós|contato|contatos|pesquisa|arquivo|ajuda|notícias
over ons|zoeken|inloggen|archief|nieuws|hulp|winkel|strona główna|o nas|szukaj|zaloguj|archiwum|aktualności|pomoc|sklep|kontakty
ana sayfa|hakkımızda|iletişim|ara|giriş|首页|关于我们|搜索|登录|联系|联系我们|新闻|帮助|ホーム|会社案内|お問い合わせ|検索|ログイン|ニュース|홈|소개|문의|검색|로그인"""
#: Buttons of cookie notices.
BUTTONS = """ok|okay|got it|accept|accept all|reject|reject all|decline|settings|more|more information|agree|i agree|close|dismiss|akzeptieren|ablehnen|alle akzeptieren
einstellungen|schließen|mehr|accepter|refuser|tout accepter|tout refuser|fermer|paramètres|aceptar|rechazar|aceptar todo|configurar|принять|отклонить|настройки
accetta|rifiuta|aceitar|recusar|accepteren|weigeren|akceptuję|odrzuć|kabul et|接受|拒绝|同意|同意する|拒否する|동의"""
#: Signs of a cookie notice.
COOKIES = re.compile(r"\bcookies?\b|small files on your device|クッキー|Cookie|файл\w* cookie|쿠키", re.I)
#: Signs of the other sentences of a cookie notice.
NOTICES = re.compile(
    r"\b(?:privacy|consent|agree|accept|browsing|preferences|experience|partners|track\w*|analy\w+|advertis\w+|personali[sz]\w+|third part\w+|datenschutz\w*|zustimm\w*|einwillig\w*"
    r"|confidentialité|consentement|acceptez|privacidad|privacidade|consentimiento|consentimento|aceptas?|aceita|consenso|toestemming|akkoord|zgod\w+|prywatnoś\w+|gizlilik)\b"
    r"|соглас|конфиденциальн|隐私|隱私|プライバシー|개인정보",
    re.I,
)
#: Signs of a footer.
FOOTERS = re.compile(r"^\W*(?:©|\(c\)|copyright\b|all rights reserved|alle rechte vorbehalten|tous droits réservés|todos los derechos)", re.I)

_NOUNS = "text|title|subtitle|headline|paragraph|caption|quote|description|introduction|content|summary|heading|image|logo|name|message|slogan"
_THINGS = "page|file|document|address|url|resource|site|content|article|link|product|item|entry|post|record|image|section"
_USES = "this page|this site|this app|this application|this website|this shop|this service|this map|this form|the page|the site|the app|the application|the shop|the map|the calendar|the gallery|the player|the reader|the viewer|the editor|our page|our site|our app|our shop|our map|our player|our reader|our viewer|our editor|our calendar|our gallery|it"
_ACTS = "enable|activate|allow|turn on|switch on|unblock"
_SCRIPTS = "javascript|js|scripts|scripting|client side scripts|client side scripting|java script"

#: Messages; {n} is each of _NOUNS, {t} each of _THINGS, {s} each of _SCRIPTS,
#: {u} each of _USES, {v} each of _ACTS. One language a paragraph.
MESSAGES = """
error|oops|sorry|not found|{t} not found|http error|application error|server error|internal server error|bad gateway|gateway timeout|gateway time out|service unavailable
service temporarily unavailable|too many requests|forbidden|access denied|access to this {t} is denied|unauthorized|bad request|request timeout|method not allowed|gone|nothing here|nothing found
something went wrong|an unexpected error occurred|an error occurred|an internal error occurred|unknown error|unexpected error|we are sorry|we re sorry|we apologise for the inconvenience|sorry for the inconvenience
we apologize for the inconvenience|go back to the start page|go back to the home page|return to the home page|back to the start page|try the search instead|check the spelling and try again|check the address and try again
check the spelling|and try again|please try again|please try again later|try again later|try again in a few minutes|please try again in a few minutes|please come back later|come back later|check back soon|we will be back shortly|we ll be back soon|be right back
the {t} you asked for|the {t} you requested|the {t} you are looking for|the {t} you were looking for|the {t} you followed a link to|the {t} you want|the {t} you tried to open|the {t} you tried to reach|the {t} you tried to access|the requested {t}|this {t}|that {t}
was not found on this server|was not found|could not be found|cannot be found|can not be found|does not exist|does not exist any more|no longer exists|isn t here any more|is not here any more|isn t here anymore|is not here anymore|isn t here|is gone|may have expired|may have moved|may have been moved|may have been removed|may have been deleted|has been moved|has been removed|has been deleted|has expired|is no longer available|is not available|is temporarily unavailable|is currently unavailable|is unavailable
or deleted|or removed|or moved|or renamed|or expired|we could not find the {t}|we can t find the {t}|we could not find that {t}|we could not find this {t}
the server was unable to complete your request|the server encountered an internal error|the server could not process your request|the server is overloaded|the upstream did not answer in time|the server did not respond in time
if this keeps happening tell the administrator|if the problem persists contact the administrator|contact the site owner if you think this is a mistake|please contact the administrator|our technicians have been informed|our team has been notified|we are working on it|we have been notified
your session has expired|your session has timed out|session expired|please sign in again|please log in again|you have been logged out due to inactivity|you have been logged out|invalid security token|reload the form|invalid token
you do not have permission to view this {t}|you do not have permission to access this {t}|you don t have permission to access this {t}|you are not authorized to view this {t}|you are not allowed to view this {t}|your address has been blocked|your ip address has been blocked|you have been blocked|unusual traffic from your network|we have detected unusual traffic|verify you are human|please complete the captcha|checking your browser before accessing
rate limit exceeded|quota exceeded|slow down and retry later|retry later|too many connections
scheduled maintenance in progress|scheduled maintenance|we are down for maintenance|down for maintenance|the site is down for maintenance|site under maintenance|under maintenance|under construction|this site is under construction|coming soon|the site is temporarily offline|the site is offline|temporarily offline|temporarily unavailable|temporarily closed for maintenance
could not connect to the database|error establishing a database connection|database error|database is read only at the moment|cannot render page|query failed|is locked|stack trace|traceback most recent call last|fatal error|uncaught exception|uncaught exception in|exception|unhandled exception|exception in thread main|undefined index in|undefined variable in|undefined index|undefined variable|sqlstate|warning|notice|parse error|load page|reference|incident|incident id|ticket|ticket id|request id|ray id|ray|support id|error id|error code|status code|segmentation fault|null pointer exception
lorem ipsum dolor sit amet|sample text|dummy text|placeholder text|example text|your text here|text goes here|text here|title here|edit me|click to edit|double click to edit|add your text|add text here|insert text here|type here
sample {n}|sample {n} edit me|dummy {n}|dummy {n} for layout only|for layout only|your {n} goes here|your {n} here|{n} goes here|replace this {n} with your own|add a {n} to tell visitors more|add an {n} to tell visitors more|type your {n} in this box|put some {n} here later|put a {n} here later|put your {n} here|insert your {n} here|enter your {n} here|this is a placeholder {n}|this is a placeholder|a placeholder {n}|this is some example {n} to fill the space|this is some example {n}|this is an example {n}|this is a sample {n}|this is dummy {n}|{n} to be announced by the site owner todo|{n} to be announced|to be announced by the site owner|to be announced|todo|the {n} will appear here|{n} will appear here|{n} placeholder|{n} coming soon|just another site|hello world
{u} cannot run without {s}|{u} can not run without {s}|{u} requires {s}|{u} needs {s}|{u} relies on {s}|{u} depends on {s}|{u} is built with {s}|{u} does not work without {s}|{u} doesn t work without {s}|{u} will not work without {s}|{u} won t work without {s}|{u} only works with {s}|{u} works only with {s}
please {v} {s}|please {v} {s} and cookies|please {v} cookies and {s}|{v} {s} and cookies|{v} cookies and {s}|{s} and cookies are required|{s} and cookies must be enabled|cookies and {s} are required|cookies and {s} must be enabled|{u} requires {s} and cookies|{u} requires cookies and {s}|{u} needs {s} and cookies|kindly {v} {s}|kindly|you need to {v} {s}|you have to {v} {s}|you must {v} {s}|{v} {s}|turn {s} on|switch {s} on|in the settings|in your settings|in the browser|for this site|for this page|to run this app|to run this site|to use this app|to use this site|for the best view|for the full view|for the best experience
{s} is required|{s} are required|{s} is disabled|{s} are disabled|{s} must be enabled|{s} has to be enabled|{s} is disabled in your browser|{s} are disabled in your browser|{s} is turned off in your browser|{s} are turned off in your browser|{s} is not available in your browser|{s} are not available in your browser|{s} is blocked in your browser|{s} are blocked in your browser|{s} is switched off in your browser|{s} is off in your browser|it looks like {s}|it seems {s}|it seems that {s}|it looks like that {s}|we noticed that {s}|we noticed {s}|we have noticed that {s}|your browser does not support {s}|your browser has {s} disabled|your browser has {s} turned off|your browser blocks {s}|your browser has blocked {s}|your browser does not run {s}
sorry but nothing works properly here without {s} enabled|nothing works properly here without {s} enabled|nothing works here without {s}|does not work without {s}|doesn t work properly without {s} enabled|does not work without {s} enabled|without {s}|for full functionality|to view this {t}|to use this {t}|to continue|to proceed|to see this {t}|in your browser|in your browser settings|and reload the {t}|and reload|then reload the {t}|then reload|wait a moment then reload|reload the {t}|refresh the {t}|please wait|please reload the {t}|loading|if nothing happens|make sure {s} can run|make sure {s} is enabled|make sure {s} are enabled|make sure {s} is allowed|make sure {s} are allowed|check that {s} is enabled|check that {s} are enabled|check that {s} is allowed|check that {s} are allowed|check that {s} can run|redirecting|you are being redirected

fehler|seite nicht gefunden|nicht gefunden|zugriff verweigert|zugriff nicht erlaubt|interner serverfehler|serverfehler|bitte versuchen sie es später erneut|versuchen sie es später erneut|bitte versuchen sie es später noch einmal|die angeforderte seite existiert nicht mehr|die angeforderte seite existiert nicht|die angeforderte seite wurde nicht gefunden|die seite wurde nicht gefunden|die gesuchte seite existiert nicht|ihre sitzung ist abgelaufen|sitzung abgelaufen|bitte melden sie sich erneut an|wegen wartungsarbeiten ist diese seite vorübergehend nicht erreichbar|wartungsarbeiten|diese seite ist vorübergehend nicht erreichbar|ein fehler ist aufgetreten|es ist ein fehler aufgetreten|dienst nicht verfügbar|zu viele anfragen
bitte aktivieren sie javascript in ihrem browser|bitte aktivieren sie javascript|bitte aktiviere javascript|javascript ist deaktiviert|javascript ist erforderlich|diese seite benötigt javascript|für diese anwendung müssen skripte eingeschaltet sein|für diese seite müssen skripte eingeschaltet sein|skripte müssen aktiviert sein|um fortzufahren|laden sie die seite neu
hier steht ein beispieltext|beispieltext|bitte eigenen text einfügen|hier text einfügen|hier steht ihr text|dies ist ein blindtext|dies ist ein blindtext für|dies ist ein blindtext für {n}|blindtext|blindtext für|blindtext für {n}|platzhaltertext|platzhalter|platzhalter für|platzhalter für {n}|mustertext|text folgt|inhalt folgt|im aufbau

erreur|page introuvable|page non trouvée|la page demandée est introuvable|la page demandée n existe pas|cette page n existe pas|cette page n existe plus|accès refusé|accès interdit|erreur interne du serveur|erreur du serveur|erreur serveur|votre session a expiré|session expirée|veuillez vous reconnecter|service momentanément indisponible|service temporairement indisponible|service indisponible|site en maintenance|en maintenance|réessayez plus tard|veuillez réessayer plus tard|une erreur est survenue|une erreur s est produite|trop de requêtes
veuillez activer javascript pour afficher cette page|veuillez activer javascript|activez javascript pour continuer|activez javascript|javascript est désactivé|javascript est requis|javascript est nécessaire|les scripts doivent être autorisés pour continuer|les scripts doivent être activés|les scripts doivent être autorisés|pour continuer|votre navigateur bloque les scripts
votre texte ici|ceci est un texte de remplissage|texte de remplissage|remplacez ce paragraphe par le vôtre|remplacez ce texte par le vôtre|exemple de texte|texte d exemple|insérez votre texte ici|ajoutez votre texte ici|ceci est un exemple de texte|texte à venir|en construction

página no encontrada|la página solicitada no existe|la página no existe|no se ha encontrado la página|no encontrado|acceso denegado|error interno del servidor|error del servidor|error interno|su sesión ha caducado|su sesión ha expirado|la sesión ha caducado|sesión caducada|el sitio está en mantenimiento|sitio en mantenimiento|en mantenimiento|vuelva más tarde|inténtelo más tarde|inténtelo de nuevo más tarde|servicio no disponible|se ha producido un error|ha ocurrido un error|demasiadas solicitudes
su navegador tiene los scripts desactivados|active javascript para continuar|active javascript|activa javascript para continuar|habilite javascript|por favor active javascript|por favor habilite javascript|javascript está desactivado|se requiere javascript|necesita javascript|para continuar
texto de ejemplo|texto de ejemplo cámbialo|cámbialo|escribe aquí tu texto|este es un texto de relleno|texto de relleno|tu texto aquí|su texto aquí|inserte su texto aquí|en construcción|próximamente

página não encontrada|a página solicitada não existe|a página não existe|não encontrado|acesso negado|erro interno do servidor|erro do servidor|erro|a sua sessão expirou|sua sessão expirou|sessão expirada|site em manutenção|o site está em manutenção|em manutenção|tente novamente mais tarde|volte mais tarde|serviço indisponível|ocorreu um erro|ative o javascript para continuar|ative o javascript|habilite o javascript|javascript está desativado|por favor ative o javascript|seu texto aqui|o seu texto aqui|insira seu texto aqui|insira aqui o seu texto|escreva aqui o seu texto|texto de exemplo|este é um texto de preenchimento|texto de preenchimento|em construção

errore|pagina non trovata|la pagina richiesta non esiste|la pagina non esiste|accesso negato|errore interno del server|errore del server|la sessione è scaduta|la tua sessione è scaduta|sessione scaduta|sito in manutenzione|il sito è in manutenzione|in manutenzione|riprova più tardi|riprovare più tardi|torna più tardi|servizio non disponibile|si è verificato un errore|attiva javascript per vedere la pagina|attiva javascript|abilita javascript|abilitare javascript|javascript è disattivato|per continuare|inserisci qui il tuo testo|testo segnaposto|testo di esempio|il tuo testo qui|testo riempitivo|in costruzione

pagina niet gevonden|niet gevonden|toegang geweigerd|interne serverfout|serverfout|fout|uw sessie is verlopen|je sessie is verlopen|sessie verlopen|deze pagina is tijdelijk niet beschikbaar|tijdelijk niet beschikbaar|deze pagina bestaat niet|deze pagina bestaat niet meer|de gevraagde pagina bestaat niet|probeer het later opnieuw|er is een fout opgetreden|onderhoud|zet javascript aan om verder te gaan|zet javascript aan|schakel javascript in|javascript is uitgeschakeld|javascript is vereist|om verder te gaan|voorbeeldtekst|hier komt uw tekst|hier komt jouw tekst|voeg hier uw tekst in|plaats hier uw tekst|dit is een voorbeeldtekst|opvultekst|in aanbouw

nie znaleziono strony|strona nie istnieje|nie znaleziono|strona nie została znaleziona|odmowa dostępu|brak dostępu|dostęp zabroniony|błąd wewnętrzny serwera|wewnętrzny błąd serwera|błąd serwera|błąd|sesja wygasła|twoja sesja wygasła|przerwa techniczna|strona w przebudowie|spróbuj ponownie później|spróbuj później|usługa niedostępna|wystąpił błąd|włącz obsługę javascript w przeglądarce|włącz obsługę javascript|włącz javascript|javascript jest wyłączony|aby kontynuować|tu wpisz swój tekst|wpisz tutaj swój tekst|przykładowy akapit do zmiany|przykładowy tekst|tekst zastępczy|w budowie

страница не найдена|не найдено|запрошенная страница не существует|страница не существует|доступ запрещён|доступ запрещен|внутренняя ошибка сервера|ошибка сервера|ошибка|сессия истекла|ваша сессия истекла|срок действия сессии истёк|сайт временно недоступен|ведутся технические работы|страница временно недоступна|технические работы|попробуйте позже|попробуйте ещё раз позже|повторите попытку позже|зайдите позже|сервис недоступен|произошла ошибка|включите javascript чтобы продолжить|включите javascript|для работы сайта требуются скрипты|для работы сайта требуется javascript|javascript отключён|javascript отключен|чтобы продолжить|здесь будет ваш текст|пример текста|пример текста замените его|замените его|введите свой текст|текст заглушка|сайт в разработке

sayfa bulunamadı|bulunamadı|erişim engellendi|erişim reddedildi|sunucu hatası oluştu|sunucu hatası|iç sunucu hatası|hata|lütfen daha sonra tekrar deneyin|daha sonra tekrar deneyin|oturumunuz sona erdi|oturum süresi doldu|bakım çalışması|site bakımda|devam etmek için javascript özelliğini açın|javascript özelliğini açın|lütfen javascript i etkinleştirin|javascript i etkinleştirin|devam etmek için|örnek metin|buraya metninizi yazın|metninizi buraya yazın|yapım aşamasında
η σελίδα δεν βρέθηκε|δεν βρέθηκε|η πρόσβαση απορρίφθηκε|δεν επιτρέπεται η πρόσβαση|εσωτερικό σφάλμα διακομιστή|σφάλμα διακομιστή|σφάλμα|η συνεδρία σας έληξε|δοκιμάστε ξανά αργότερα|υπό συντήρηση|ενεργοποιήστε τη javascript|ενεργοποιήστε την javascript|ενεργοποιήστε το javascript|για να συνεχίσετε|κείμενο παραδείγματος|δείγμα κειμένου|γράψτε εδώ το κείμενό σας|υπό κατασκευή
الصفحة غير موجودة|تم رفض الوصول|خطأ في الخادم|خطأ داخلي في الخادم|انتهت صلاحية الجلسة|انتهت جلستك|الموقع تحت الصيانة|يرجى المحاولة لاحقا|حاول مرة أخرى لاحقا|يرجى تفعيل جافا سكريبت|يرجى تفعيل javascript|قم بتفعيل javascript|للمتابعة|نص تجريبي|اكتب النص هنا|ضع النص هنا
पृष्ठ नहीं मिला|पेज नहीं मिला|प्रवेश निषेध|सर्वर त्रुटि|आंतरिक सर्वर त्रुटि|कृपया बाद में पुनः प्रयास करें|कृपया javascript सक्षम करें|कृपया जावास्क्रिप्ट सक्षम करें|जारी रखने के लिए|नमूना पाठ|यहाँ अपना पाठ लिखें

您访问的页面不存在|页面不存在|找不到页面|页面未找到|未找到页面|拒绝访问|访问被拒绝|禁止访问|服务器内部错误|内部服务器错误|服务器错误|服务器繁忙|会话已过期|登录已过期|请重新登录|网站维护中|系统维护中|正在维护|维护中|请稍后再试|请稍后重试|服务不可用|发生错误|出错了|请启用 javascript 后继续|请启用 javascript|请启用javascript后继续|请启用javascript|请开启 javascript|请开启javascript|请打开javascript|需要启用 javascript|需要启用javascript|本网站需要启用 javascript|这是示例文本|示例文本|请在此处输入文字|在此处输入文字|在此输入文字|占位文本|此处填写内容|敬请期待|网站建设中
お探しのページは見つかりませんでした|お探しのページは見つかりません|ページが見つかりません|ページが見つかりませんでした|アクセスが拒否されました|アクセスできません|サーバーエラーが発生しました|サーバーエラー|内部サーバーエラー|エラーが発生しました|ただいまメンテナンス中です|メンテナンス中です|メンテナンス中|セッションの有効期限が切れました|セッションが切れました|もう一度ログインしてください|しばらくしてから再度お試しください|後でもう一度お試しください|javascriptを有効にしてください|javascript を有効にしてください|スクリプトを有効にしてください|サンプルテキストです|サンプルテキスト|ここにテキストを入力してください|ダミーテキスト|準備中です|工事中
페이지를 찾을 수 없습니다|요청하신 페이지를 찾을 수 없습니다|접근이 거부되었습니다|액세스가 거부되었습니다|서버 오류가 발생했습니다|서버 오류|내부 서버 오류|오류가 발생했습니다|세션이 만료되었습니다|점검 중입니다|나중에 다시 시도해 주세요|잠시 후 다시 시도해 주세요|javascript를 활성화해 주세요|javascript를 사용하도록 설정하세요|자바스크립트를 활성화해 주세요|자바스크립트를 켜 주세요|샘플 텍스트입니다|예시 텍스트|여기에 텍스트를 입력하세요
"""
#: Further messages, put together from parts; languages as paragraphs.
MORE_MESSAGES = """
oops that {t} can t be found|that {t} can t be found|this {t} can t be found|that {t} could not be found|that {t} couldn t be found|can t be found|couldn t be found|cannot be displayed|can t be displayed|can t be reached|could not be reached|isn t working|is not working|isn t available|not available|doesn t exist|doesn t exist any more|doesn t exist anymore|does not exist anymore|no longer available
it looks like nothing was found at this location|nothing was found at this location|maybe try a search|the web server is not returning a connection|connection timed out|connection refused|connection reset|connection failed|database connection failed|took too long to respond|redirected you too many times|refused to connect|unexpectedly closed the connection|err connection timed out|err connection refused|err name not resolved|err too many redirects|err empty response|dns probe finished nxdomain|server not found|host not found
the service is unavailable|service is unavailable|the service is temporarily unavailable|unable to access this {t}|you are unable to access this {t}|sorry you have been blocked|request blocked|we can t connect to the server for this app or website at this time|access to this {t} has been denied|because we believe you are using automation tools to browse the website|just a moment|checking if the site connection is secure|attention required|verifying you are human|this may take a few seconds|ddos protection by|performance and security by|looks like something went wrong|whoops|whoops looks like something went wrong|that s an error|that s all we know|an error has occurred|unable to complete your request|internal error or misconfiguration
briefly unavailable for scheduled maintenance|temporarily unavailable due to scheduled maintenance|unavailable due to maintenance|down for scheduled maintenance|check back in a minute|please check back later|check back later|this account has been suspended|account suspended|contact your hosting provider for more information|this domain is parked|this domain is for sale|domain expired|this domain has expired|if you see this page the nginx web server is successfully installed and working|further configuration is required|welcome to nginx|it works|apache2 ubuntu default page|test page for the apache http server|default web page|coming soon stay tuned|our new website is coming soon|our website is coming soon|website coming soon|stay tuned|session timeout|please log in to continue|please sign in to continue|login required|invalid request|the request could not be satisfied|no input file specified|file not found|directory listing denied|you don t have permission to access this resource|resource limit is reached|bandwidth limit exceeded
please {v} it|please {v} it to continue|please {v} it in your browser|please {v} it in your browser settings|doesn t work properly without|this website requires {s}|this website needs {s}|this website requires {s} and cookies|requires {s}|requires {s} to work|requires {s} to function properly|{s} is not enabled|{s} not enabled|your browser doesn t support {s}|browser does not support {s}|{s} disabled|{s} required|{s} must be turned on|{v} {s} in your browser|{v} {s} to view this {t}|{v} {s} to continue|{v} {s} to run this app|need to {v} {s}|you need to {v} {s} to run this app|you need to {v} {s} to view this {t}|your browser is not supported|your browser is out of date|unsupported browser|please update your browser|please upgrade your browser

konnte nicht gefunden werden|konnten wir nicht finden|wurde nicht gefunden|wurde leider nicht gefunden|nicht verfügbar|ist nicht verfügbar|ist derzeit nicht verfügbar|ist vorübergehend nicht verfügbar|ist nicht erreichbar|ist derzeit nicht erreichbar|existiert nicht|existiert nicht mehr|existiert leider nicht|befindet sich derzeit im wartungsmodus|im wartungsmodus|wartungsmodus|wird gerade gewartet|zugriff nicht gestattet|keine berechtigung|sie haben keine berechtigung|etwas ist schiefgelaufen|ein unerwarteter fehler ist aufgetreten|benötigt javascript|erfordert javascript|aktivieren sie javascript|bitte javascript aktivieren|javascript muss aktiviert sein|javascript ist nicht aktiviert|ihr browser unterstützt kein javascript|in den einstellungen ihres browsers|in ihrem browser|hier entsteht eine neue website|demnächst verfügbar|interner fehler
est introuvable|est en cours de maintenance|en cours de maintenance|est en maintenance|merci de revenir plus tard|est désactivé dans votre navigateur|doit être activé|veuillez l activer|n est pas disponible|n est plus disponible|est temporairement indisponible|est indisponible|n a pas été trouvée|n a pas pu être trouvée|n existe pas|n existe plus|une erreur inattendue est survenue|vous n avez pas accès à cette page|vous n êtes pas autorisé à accéder à cette page|nécessite javascript|votre navigateur ne prend pas en charge javascript|bientôt disponible|prochainement|erreur interne
no existe|ya no existe|no se encuentra|no se ha encontrado|no se encontró|no pudo ser encontrada|no está disponible|ya no está disponible|no disponible|estamos realizando tareas de mantenimiento|estamos en mantenimiento|está en mantenimiento|disculpe las molestias|disculpen las molestias|no tiene permiso para acceder a esta página|requiere javascript|javascript está deshabilitado|su navegador no soporta javascript|habilite javascript en su navegador|algo salió mal|error inesperado|error interno|error 404|inicie sesión de nuevo
não existe|já não existe|não foi encontrada|não foi encontrado|não pôde ser encontrada|não está disponível|está indisponível|indisponível|pedimos desculpa pelo incómodo|desculpe o transtorno|estamos em manutenção|algo deu errado|não tem permissão para aceder a esta página|você não tem permissão para acessar esta página|requer javascript|ative o javascript no seu navegador|habilite o javascript no seu navegador|em breve
non esiste|non esiste più|non è stata trovata|non trovato|non è disponibile|non è più disponibile|non disponibile|ci scusiamo per il disagio|siamo in manutenzione|è in manutenzione|qualcosa è andato storto|non hai i permessi per accedere a questa pagina|richiede javascript|attiva javascript nel tuo browser|il tuo browser non supporta javascript|prossimamente
kan niet worden gevonden|kon niet worden gevonden|is niet gevonden|werd niet gevonden|bestaat niet|bestaat niet meer|is niet beschikbaar|is niet meer beschikbaar|niet beschikbaar|onze excuses voor het ongemak|in onderhoud|er ging iets mis|er is iets misgegaan|u hebt geen toegang tot deze pagina|vereist javascript|schakel javascript in om verder te gaan|uw browser ondersteunt geen javascript|binnenkort beschikbaar|probeer het later nog eens
nie została znaleziona|nie został znaleziony|nie istnieje|już nie istnieje|jest niedostępna|jest niedostępny|niedostępna|przepraszamy za utrudnienia|trwają prace konserwacyjne|w trakcie przerwy technicznej|coś poszło nie tak|wystąpił nieoczekiwany błąd|nie masz uprawnień do tej strony|wymaga javascript|wymaga obsługi javascript|twoja przeglądarka nie obsługuje javascript|wkrótce|już wkrótce
не найдена|не найден|не существует|больше не существует|недоступна|недоступен|временно недоступна|временно недоступен|находится на обслуживании|на техническом обслуживании|приносим извинения за неудобства|что то пошло не так|произошла непредвиденная ошибка|у вас нет доступа к этой странице|требуется javascript|требует javascript|включите поддержку javascript|ваш браузер не поддерживает javascript|javascript отключен в вашем браузере|сайт на реконструкции|скоро открытие
сторінку не знайдено|сторінка не знайдена|не знайдено|доступ заборонено|помилка сервера|внутрішня помилка сервера|спробуйте пізніше|увімкніть javascript|сайт тимчасово недоступний|сталася помилка|сесія закінчилася|страницата не е намерена|достъпът е отказан|вътрешна грешка на сървъра|моля активирайте javascript|възникна грешка|stranica nije pronađena|страница није пронађена|pristup odbijen|omogućite javascript|stran ni bila najdena|dostop zavrnjen|omogočite javascript
sidan kunde inte hittas|sidan hittades inte|sidan finns inte|kunde inte hittas|hittades inte|finns inte|åtkomst nekad|internt serverfel|serverfel|ett fel uppstod|ett fel har uppstått|något gick fel|försök igen senare|din session har gått ut|sessionen har upphört|under underhåll|tillfälligt otillgänglig|är inte tillgänglig|aktivera javascript|du måste aktivera javascript|kräver javascript|för att använda denna sida|för att visa denna sida|för att fortsätta|exempeltext|din text här|kommer snart|sidan är under uppbyggnad
siden blev ikke fundet|siden findes ikke|siden kunne ikke findes|blev ikke fundet|findes ikke|adgang nægtet|intern serverfejl|der opstod en fejl|noget gik galt|prøv igen senere|din session er udløbet|under vedligeholdelse|er ikke tilgængelig|aktiver javascript|aktivér javascript|kræver javascript|for at fortsætte|for at bruge denne side|eksempeltekst|din tekst her|siden finnes ikke|siden ble ikke funnet|fant ikke siden|finnes ikke|ble ikke funnet|ingen tilgang|tilgang nektet|intern serverfeil|det oppstod en feil|noe gikk galt|prøv igjen senere|økten er utløpt|under vedlikehold|er ikke tilgjengelig|krever javascript|for å fortsette|for å bruke denne siden|eksempeltekst|kommer snart
sivua ei löytynyt|sivua ei löydy|ei löytynyt|ei löydy|pääsy kielletty|pääsy estetty|palvelinvirhe|sisäinen palvelinvirhe|tapahtui virhe|on tilapäisesti pois käytöstä|tilapäisesti pois käytöstä|ei ole käytettävissä|ei ole saatavilla|yritä myöhemmin uudelleen|yritä uudelleen myöhemmin|istuntosi on vanhentunut|huoltokatko|ota javascript käyttöön|javascript on pois käytöstä|vaatii javascriptin|jatkaaksesi|esimerkkiteksti|tulossa pian
stránka nenalezena|stránka nebyla nalezena|stránka neexistuje|nebyla nalezena|nenalezeno|neexistuje|přístup odepřen|přístup zamítnut|interní chyba serveru|chyba serveru|došlo k chybě|něco se pokazilo|zkuste to prosím později|zkuste to později|platnost relace vypršela|probíhá údržba|není k dispozici|je dočasně nedostupná|povolte javascript|zapněte javascript|pro zobrazení stránky|pro pokračování|vyžaduje javascript|ukázkový text|stránka nebola nájdená|prístup zamietnutý|chyba servera|povoľte javascript|vyskytla sa chyba
az oldal nem található|a keresett oldal nem található|nem található|nem létezik|hozzáférés megtagadva|belső szerverhiba|szerverhiba|hiba történt|valami hiba történt|kérjük próbálja újra később|próbálja meg később|a munkamenet lejárt|karbantartás alatt|az oldal karbantartás alatt áll|nem érhető el|engedélyezze a javascriptet|kérjük engedélyezze a javascriptet|kapcsolja be a javascriptet|a folytatáshoz|mintaszöveg|hamarosan
pagina nu a fost găsită|pagina nu există|nu a fost găsită|nu a fost găsit|nu există|acces interzis|eroare internă de server|eroare de server|a apărut o eroare|ceva nu a mers bine|încercați din nou mai târziu|vă rugăm încercați mai târziu|sesiunea a expirat|în mentenanță|site în mentenanță|nu este disponibilă|activați javascript|vă rugăm activați javascript|pentru a continua|text exemplu|în curând
không tìm thấy trang|không tìm thấy|trang không tồn tại|trang bạn tìm kiếm không tồn tại|truy cập bị từ chối|lỗi máy chủ|lỗi máy chủ nội bộ|đã xảy ra lỗi|vui lòng thử lại sau|phiên làm việc đã hết hạn|đang bảo trì|website đang bảo trì|vui lòng bật javascript|hãy bật javascript|để tiếp tục|văn bản mẫu
halaman tidak ditemukan|halaman yang anda cari tidak ditemukan|tidak ditemukan|akses ditolak|kesalahan server|kesalahan server internal|terjadi kesalahan|silakan coba lagi nanti|coba lagi nanti|sesi anda telah berakhir|sedang dalam perbaikan|dalam pemeliharaan|aktifkan javascript|harap aktifkan javascript|untuk melanjutkan|teks contoh|segera hadir|laman tidak dijumpai|ralat pelayan
aradığınız sayfa bulunamadı|aradığınız sayfa mevcut değil|sayfa mevcut değil|bir hata oluştu|bir şeyler ters gitti|geçici olarak hizmet dışı|şu anda kullanılamıyor|bakımdayız|tarayıcınızda javascript devre dışı|javascript etkinleştirin|çok yakında|yakında hizmetinizdeyiz
الصفحة التي تبحث عنها غير موجودة|الصفحة المطلوبة غير موجودة|حدث خطأ|حدث خطأ ما|خطأ داخلي|غير متاح حاليا|الموقع قيد الصيانة|قريبا|صفحه مورد نظر یافت نشد|صفحه یافت نشد|دسترسی غیرمجاز|خطای سرور|لطفا جاوا اسکریپت را فعال کنید
הדף לא נמצא|העמוד לא נמצא|הדף שחיפשת לא נמצא|הגישה נדחתה|שגיאת שרת|אירעה שגיאה|נסה שוב מאוחר יותר|האתר בתחזוקה|יש להפעיל javascript|אנא הפעל javascript
ไม่พบหน้าที่คุณต้องการ|ไม่พบหน้า|ไม่พบหน้านี้|ไม่พบหน้าเว็บ|การเข้าถึงถูกปฏิเสธ|เกิดข้อผิดพลาด|กรุณาลองใหม่อีกครั้ง|โปรดเปิดใช้งาน javascript|กรุณาเปิดใช้งาน javascript|เว็บไซต์ปิดปรับปรุง
找不到網頁|找不到頁面|頁面不存在|您要找的頁面不存在|您访问的页面不存在或已被删除|页面走丢了|存取被拒|拒絕存取|伺服器錯誤|內部伺服器錯誤|發生錯誤|請稍後再試|請重新登入|系統維護中|網站維護中|請啟用 javascript|請啟用javascript|您的瀏覽器不支援 javascript|您的瀏覽器不支援javascript|您的浏览器不支持 javascript|您的浏览器不支持javascript|浏览器不支持 javascript|出了点问题|页面加载失败|正在加载
このページを表示するにはjavascriptを有効にしてください|表示するにはjavascriptを有効にしてください|javascriptが無効です|javascriptが必要です|お使いのブラウザはjavascriptに対応していません|指定されたページは存在しません|ページは存在しません|見つかりませんでした|問題が発生しました|しばらくお待ちください|近日公開
요청하신 페이지가 존재하지 않습니다|페이지가 존재하지 않습니다|존재하지 않는 페이지입니다|페이지를 표시할 수 없습니다|문제가 발생했습니다|서비스를 이용할 수 없습니다|javascript가 필요합니다|javascript를 지원하지 않는 브라우저입니다|준비 중입니다
"""
#: The cores of messages, whatever is said around them; languages as paragraphs.
CORES = """
unavailable|is unavailable|not available|isn t available|is not available|offline|is down|not found|could not be found|does not exist|doesn t exist|no longer exists|denied|access denied|blocked|forbidden|unauthorized|not authorized|not authorised|not allowed|bad request|invalid request|rate limited|rate limit|too many requests|timed out|time out|timeout|expired|has expired|went wrong|having trouble|error occurred|encountered an error|undergoing maintenance|under maintenance|maintenance|under construction|coming soon|be back soon|failed|failed to load|could not complete your request|could not verify|did not receive a timely response|unreachable|server error|client error|http error|unsupported browser
{s} is not available|{s} is unavailable|enable {s}|turn {s} on|turn on {s}|requires {s}|require {s}|needs {s}|need {s}|{s} to be enabled|{s} is disabled|{s} disabled|{s} must be enabled|without {s}|{s} is required|{s} required|activate {s}|allow {s}|support {s}|detected that {s} is disabled|disable any ad blocker|disable your ad blocker|enable cookies|cookies are disabled|cookies are required
couldn t find|could not find|can t find|cannot find|no such|could not process|could not be processed|could not load|could not connect|unable to|can t be processed|has been deleted|has been removed|been deleted|been removed|been blocked|was blocked|did not respond|didn t respond|broke|be logged in|log in to continue|sign in to continue|you are human|you are a human|not a robot|not a bot|cookies must be enabled|{s} must be on|overloaded|suspended|shut down|closed down|doesn t support|does not support|error|oops
undefined variable|undefined index|undefined offset|division by zero|null pointer|stack overflow|out of memory|parse error|syntax error|type error|fatal error|connection refused|access denied for user|unknown column|unknown database|call to undefined function
nicht gefunden|nicht verfügbar|nicht mehr verfügbar|nicht erreichbar|existiert nicht|existiert nicht mehr|nicht vorhanden|verweigert|gesperrt|abgelaufen|fehler aufgetreten|fehlgeschlagen|wartung|wartungsarbeiten|wartungsmodus|im aufbau|überlastet|javascript aktivieren|javascript einschalten|aktivieren sie javascript|javascript deaktiviert|ohne javascript|benötigt javascript|javascript erforderlich|javascript wird benötigt|nicht finden|nicht geladen|nicht möglich|gelöscht|entfernt|blockiert|geschlossen|verschoben|keine berechtigung|angemeldet sein|schiefgelaufen|schief gegangen
introuvable|indisponible|pas disponible|plus disponible|n existe pas|n existe plus|refusé|accès refusé|interdit|accès interdit|expiré|expirée|erreur interne|erreur s est produite|erreur est survenue|maintenance|en construction|activer javascript|activez javascript|javascript désactivé|sans javascript|nécessite javascript|javascript est nécessaire|inaccessible|plus accessible|pas accessible|fermé pour maintenance|supprimée|supprimé|bloqué|bloquée|pas été trouvée|pas pu être trouvée|impossible de trouver|impossible d afficher|problème est survenu|échoué|surchargé
no encontrada|no encontrado|no existe|ya no existe|no disponible|no está disponible|denegado|acceso denegado|prohibido|no tienes permiso|no tiene permiso|caducado|expirado|ha expirado|mantenimiento|en mantenimiento|en construcción|fuera de servicio|salió mal|error interno|activar javascript|habilitar javascript|active javascript|habilite javascript|sin javascript|eliminada|eliminado|bloqueado|no se pudo|no pudimos encontrar|no hemos encontrado|no se puede|ha fallado|problema|requiere javascript|necesita javascript
não encontrada|não encontrado|não existe|não disponível|indisponível|negado|acesso negado|proibido|não tem permissão|expirou|expirada|manutenção|em manutenção|em construção|fora do ar|deu errado|erro interno|ativar javascript|ative javascript|habilitar javascript|ative o javascript|habilite o javascript|sem javascript|não foi possível|removida|removido|excluída|eliminada|bloqueado|não conseguimos encontrar|ocorreu um problema|requer javascript
non trovata|non trovato|non esiste|non disponibile|negato|accesso negato|vietato|accesso vietato|scaduta|scaduto|manutenzione|in manutenzione|in costruzione|fuori servizio|andato storto|errore interno|attivare javascript|abilitare javascript|attiva javascript|abilita javascript|senza javascript|rimossa|rimosso|eliminata|cancellata|bloccato|impossibile|non è possibile|si è verificato un problema|richiede javascript
niet gevonden|bestaat niet|niet beschikbaar|onbereikbaar|niet bereikbaar|geweigerd|geblokkeerd|verlopen|onderhoud|in onderhoud|in aanbouw|misgegaan|interne fout|javascript inschakelen|schakel javascript in|zet javascript aan|zonder javascript|verwijderd|verplaatst|niet vinden|niet geladen|er is een probleem|vereist javascript
nie znaleziono|nie istnieje|niedostępna|niedostępny|zabroniony|odmowa dostępu|zablokowany|wygasła|wygasł|konserwacja|przerwa techniczna|w budowie|błąd serwera|włącz javascript|włączyć javascript|bez javascript|usunięta|usunięto|została usunięta|wystąpił problem|nie można|nie udało się|wymaga javascript
не найдена|не найден|не существует|недоступна|недоступен|ограничен|ограничена|запрещен|запрещён|запрещена|заблокирован|истекла|истек|истёк|техническое обслуживание|технические работы|обслуживании|в разработке|ошибка сервера|произошла ошибка|включите javascript|включить javascript|без javascript|удалена|удалён|удален|перемещена|не удалось|невозможно|не отвечает|перегружен|видалено|не вдалося|требуется javascript|не знайдено|не існує|недоступна|заборонено|помилка сервера
hittas inte|hittades inte|finns inte|otillgänglig|är nere|nekad|spärrad|löpt ut|gått ut|underhåll|under uppbyggnad|serverfel|gick fel|kan inte hitta|kunde inte hitta|hittar inte|borttagen|har tagits bort|blockerad|kunne ikke finde|kan ikke finde|kunne ikke finne|kan ikke finne|fant ikke|slettet|fjernet|blokeret|blokkert|aktivera javascript|kräver javascript|utan javascript|ikke fundet|findes ikke|utilgængelig|nægtet|udløbet|vedligeholdelse|under opbygning|gik galt|aktiver javascript|kræver javascript|ikke funnet|finnes ikke|utilgjengelig|utløpt|vedlikehold|under oppbygging|gikk galt|aktiver javascript|krever javascript
ei löytynyt|ei löydy|ei ole olemassa|ei ole käytettävissä|ei saatavilla|estetty|kielletty|vanhentunut|poistettu|epäonnistui|huollossa|huoltokatko|rakenteilla|odstraněna|smazána|nelze|nepodařilo se|palvelinvirhe|ota javascript käyttöön|vaatii javascriptin|nenalezena|nebyla nalezena|neexistuje|nedostupná|odepřen|zamítnut|vypršela|údržba|ve výstavbě|chyba serveru|povolte javascript|zapněte javascript|bez javascriptu
nem található|nem létezik|nem elérhető|megtagadva|lejárt|törölték|eltávolították|nem sikerült|karbantartás|karbantartás alatt|fejlesztés alatt|ștearsă|eliminată|nu am găsit|nu s a putut|szerverhiba|engedélyezze a javascriptet|nu a fost găsită|nu a fost gasita|nu există|indisponibilă|indisponibil|interzis|refuzat|a expirat|mentenanță|în construcție|eroare de server|activați javascript
không tìm thấy|không tồn tại|bị từ chối|không khả dụng|hết hạn|bảo trì|đã bị xóa|lỗi xảy ra|có lỗi|không thể|tidak ada|dihapus|tidak dapat|gagal|kaldırıldı|silindi|ulaşılamıyor|görüntülenemiyor|başarısız|đang xây dựng|lỗi máy chủ|bật javascript|tidak ditemukan|tidak tersedia|ditolak|kedaluwarsa|pemeliharaan|perbaikan|sedang dibangun|kesalahan server|aktifkan javascript|bulunamadı|mevcut değil|kullanılamıyor|hizmet dışı|reddedildi|engellendi|süresi doldu|bakım|yapım aşamasında|sunucu hatası|javascript etkinleştirin
لم يتم العثور على|تم حذف|تعذر|لا يمكن|غير موجودة|غير موجود|غير متوفرة|غير متاحة|غير متاح|تم رفض الوصول|ممنوع|انتهت صلاحية|تحت الصيانة|قيد الصيانة|قيد الإنشاء|خطأ في الخادم|حدث خطأ|تفعيل جافا سكريبت|تفعيل javascript|לא נמצא|לא קיים|לא זמין|נדחתה|נחסמה|פג תוקף|תחזוקה|בבנייה|שגיאת שרת|להפעיל javascript|δεν βρέθηκε|δεν υπάρχει|δεν είναι διαθέσιμη|απορρίφθηκε|έληξε|συντήρηση|υπό κατασκευή|σφάλμα διακομιστή|ενεργοποιήστε τη javascript
页面未找到|未找到|找不到|已被删除|已删除|开小差|出错|失败|沒有找到|已刪除|削除されました|移動しました|できませんでした|찾지 못했습니다|삭제되었습니다|실패했습니다|ถูกลบ|ไม่สามารถ|不存在|不可用|无法访问|无法显示|已过期|已失效|被拒绝|禁止访问|维护中|正在维护|建设中|服务器错误|启用javascript|启用 javascript|開啟javascript|無法顯示|無法存取|不存在|已過期|維護中|建置中|存在しません|見つかりません|見つかりませんでした|利用できません|表示できません|アクセスできません|期限が切れました|メンテナンス中|工事中|準備中|エラーが発生しました|javascriptを有効|javascriptが無効|존재하지 않습니다|존재하지 않는|찾을 수 없습니다|사용할 수 없습니다|이용할 수 없습니다|표시할 수 없습니다|거부되었습니다|만료되었습니다|점검 중|준비 중|오류가 발생했습니다|javascript를 활성화|ไม่พบ|ไม่มีอยู่|ใช้งานไม่ได้|ถูกปฏิเสธ|หมดอายุ|ปิดปรับปรุง
"""
#: What stands beside messages and says nothing by itself: it counts as covered only where a message is.
BESIDE = """sorry|we re sorry|we re sorry but|we are sorry but|sorry but|oops|uh oh|hmm|please|unfortunately|it seems|but|or|and|it|error|error code|http error|http status|status|code|for more information|learn more|at this time|right now|to continue|later|again|back|the|a
the {t}|this {t}|that {t}|your {t}|the {t} you were looking for|the {t} you are looking for|the {t} you requested|the requested {t}|the requested url|the site|this website|the website|our website|website|site|this service|your browser|your browser settings|in your browser settings|the server|the link you followed|you followed|may be broken|was not found on this server
nginx|apache|openresty|cloudflare|varnish|varnish cache server|varnish cache|iis|microsoft iis|tomcat|apache tomcat|litespeed|lighttpd|ubuntu|debian|centos|unix|win64|openssl|php|server at|port|ray id|your ip|request id|klhost|http|https|www
leider|hoppla|ups|entschuldigung|die seite|diese seite|die website|diese website|die webseite|diese webseite|die gesuchte seite|die angeforderte seite|die aufgerufene seite|der server|der dienst|bitte|ihr browser|fehler|oups|désolé|désolée|nous sommes désolés|malheureusement|la page|cette page|la page que vous cherchez|la page que vous recherchez|la page demandée|ce site|le site|le serveur|le service|javascript|erreur|merci|dans votre navigateur
lo sentimos|lo sentimos pero|vaya|ups|la página|esta página|la página que busca|la página que buscas|la página que está buscando|la página solicitada|el sitio|este sitio|el servidor|por favor|en su navegador|error|desculpe|desculpa|lamentamos|ops|a página|esta página|a página que procura|a página que você procura|a página solicitada|o site|este site|o servidor|spiacenti|ci dispiace|siamo spiacenti|ops|la pagina|questa pagina|la pagina che cerchi|la pagina che stai cercando|la pagina richiesta|il sito|questo sito|errore
helaas|oeps|deze pagina|de pagina|de pagina die u zoekt|de opgevraagde pagina|deze website|de website|deze site|fout|przepraszamy|niestety|ups|strona|ta strona|ta witryna|witryna|strona której szukasz|żądana strona|błąd|к сожалению|извините|упс|страница|эта страница|запрашиваемая страница|запрошенная страница|страница которую вы ищете|сайт|этот сайт|сервер|ошибка|на жаль|вибачте|сторінка|помилка
tyvärr|hoppsan|beklagar|sidan|denna sida|sidan du söker|webbplatsen|fel|beklager|desværre|ups|siden|denne side|denne siden|siden du leter etter|siden du leder efter|nettsiden|feil|fejl|valitettavasti|hups|sivu|sivusto|palvelu|virhe|omlouváme se|bohužel|jejda|stránka|tato stránka|chyba|sajnáljuk|hoppá|az oldal|ez az oldal|hiba|ne pare rău|ups|pagina|această pagină|eroare|xin lỗi|rất tiếc|trang|trang web|lỗi|maaf|halaman|halaman ini|situs|kesalahan
üzgünüz|maalesef|sayfa|bu sayfa|site|hata|عذرا|عفوا|للأسف|الصفحة|هذه الصفحة|الموقع|خطأ|מצטערים|סליחה|הדף|שגיאה|ขออภัย|抱歉|很抱歉|对不起|對不起|您访问的|该页面|此页面|申し訳ありません|申し訳ございません|죄송합니다|페이지
the|a|an|this|that|these|of|to|in|on|at|for|from|by|with|and|or|but|if|it|its|is|are|was|were|be|been|has|have|may|can|cannot|could|will|would|should|must|you|your|you re|we|we ve|we re|we ll|our|us|there|here|s|t|re|ve|not|no|any|all|other|another|some|as|so|then|which|properly|again|later|soon|now|back|down|currently|temporarily|permanently|automatically|unexpectedly
page|pages|web|link|links|address|url|file|files|document|content|resource|item|product|video|image|post|article|store|shop|account|server|host|gateway|proxy|upstream|application|app|browser|device|cookies|cookie|header|javascript|js|scripts|settings|request|requested|response|connection|network|internet|session|administrator|webmaster|owner|support|team|ad blocker|extension|version|user|domain|database|service
try|trying|reload|reloading|refresh|retry|check|wait|return|go|visit|contact|report|enable|disable|allow|activate|turn|update|upgrade|use|using|view|see|access|continue|proceed|complete|process|verify|find|finding|found|looking|reach|open|load|loading|display|moved|removed|deleted|changed|renamed|broken|mistyped|typed|followed|detected|disabled|enabled|required|authorized|problem|problems|issue|issues|persists|trouble|minutes|seconds|moment|few|slow|large|too|due|because|site s|something|detected that|we ve detected that|permission|exists|exist|such|listing|service|end|something|oh no|oh|what|who|want|wants|trying to|valid|correct|correctly|administrators|logged|requires|reach|click|button|below|following|reason|time|times|number|id|permission|root|localhost|html|index|home page|homepage
die|der|das|den|dem|des|ein|eine|einen|diese|dieser|dieses|ist|sind|wurde|wird|werden|kann|konnte|nicht|leider|bitte|sie|ihr|ihre|ihrem|ihren|wir|um|zu|und|oder|auf|aus|in|im|für|mit|von|später|erneut|derzeit|zurzeit|vorübergehend|wieder|gesuchte|angeforderte|aufgerufene|seite|inhalt|webseite|website|server|dienst|adresse|datei|browser|einstellungen|nutzen|verwenden|anzeigen|laden|versuchen|müssen|möglicherweise|startseite|mehr|momentan|aktuell|einigen|minuten|es|zugriff|noch|nochmal|überprüfen|versuche|link
le|la|les|l|un|une|des|de|du|d|ce|cet|cette|ces|que|qui|vous|votre|vos|nous|est|sont|a|été|n|ne|pas|plus|s|et|ou|pour|dans|sur|en|par|doit|devez|veuillez|merci|page|site|contenu|serveur|service|navigateur|lien|adresse|fichier|demandée|demandé|cherchez|recherchez|utiliser|afficher|voir|continuer|recharger|réessayer|réessayez|plus tard|actuellement|temporairement|momentanément|erreur|actuellement|accès|lien|désolé|ici|avoir|plus|moment|quelques|minutes
el|los|las|lo|una|unos|del|al|esta|este|esto|que|usted|su|tu|se|es|son|está|están|ha|han|sido|no|y|o|para|en|por|con|de|debe|puede|favor|sentimos|página|sitio|contenido|servidor|servicio|navegador|enlace|dirección|archivo|solicitada|solicitado|busca|buscas|usar|ver|mostrar|continuar|recargar|inténtelo|intente|más tarde|actualmente|temporalmente|error|vuelva|vuelve|pronto|acceso|momento|minutos|unos|más|encontrar|problemas
o|os|as|um|uma|do|da|dos|das|ao|esta|este|que|você|seu|sua|é|são|está|foi|não|e|ou|para|em|por|com|deve|pode|sítio|conteúdo|serviço|endereço|ficheiro|arquivo|volte|tente|novamente|mais tarde|em breve|temporariamente|atualmente|il|lo|gli|uno|della|dello|nel|questa|questo|che|è|sono|stata|stato|non|per|con|si|prega|pagina|sito|contenuto|servizio|indirizzo|riprova|più tardi|temporaneamente|al momento|la|accesso|trovare|qualche|minuto|acesso|encontrar|momento|problema
de|het|een|deze|dit|die|u|uw|je|is|zijn|werd|wordt|kan|niet|en|of|om|te|op|in|voor|met|van|server|pagina|inhoud|dienst|tijdelijk|momenteel|later|opnieuw|probeer|ta|ten|to|jest|są|została|został|nie|i|lub|aby|na|w|do|z|strona|podana|witryna|serwer|usługa|obecnie|tymczasowo|później|ponownie|spróbuj|proszę|эта|этот|это|вы|ваш|мы|и|или|чтобы|на|в|для|к|не|страница|сайт|сайту|доступ|сервер|сервис|временно|сейчас|позже|снова|попробуйте|пожалуйста|была|был|проверьте|правильность|адреса|адрес|может|быть|wyświetleniem|wyświetlić|strony|stronę|stron|serwera|problem|bereiken|vinden|laden|toegang
den|det|en|ett|som|du|din|ditt|är|var|har|och|eller|för|att|på|i|med|inte|sidan|webbplatsen|servern|tillfälligt|senare|igen|försök|et|er|og|til|af|ikke|siden|serveren|midlertidigt|prøv|av|nå|midlertidig|sivu|sivusto|sivustoa|palvelu|on|tämä|ja|tai|tilapäisesti|myöhemmin|uudelleen|je|byla|byl|nebo|na|pro|stránka|server|služba|dočasně|později|znovu|zkuste|az|a|egy|ez|oldal|weboldal|szerver|jelenleg|később|újra|áll|este|nu|și|sau|pe|pentru|pagina|site ul|serverul|momentan|mai târziu|letar|efter|söker|leder|leter|etsimääsi|sivua|požadovaná|požadovanou|stránku|zobrazit|kért|keresett|căutată|solicitată|vi|får|kan
trang|này|bạn|web|máy chủ|hiện|sau|lại|thử|halaman|ini|situs|yang|anda|sedang|dalam|server|nanti|lagi|coba|bu|sayfa|site|sunucu|şu anda|sonra|tekrar|deneyin|lütfen|الصفحة|المطلوبة|التي|هذه|هذا|الموقع|الخادم|في|على|من|لاحقا|מצטערים|הדף|העמוד|האתר|השרת|عذر ا|عفو ا|tiếc|rất|đã|tìm|kiếm|minta|cari|tidak|maaf|istediğiniz|aradığınız|sayfaya|sayfayı|שוב|מאוחר|η|το|ο|σελίδα|που|ζητήσατε|αυτή|ιστότοπος|διακομιστής|την|αργότερα
您|您要访问的|访问|的|页面|网页|网站|服务器|内容|请|稍后|重试|已|或|可能|暂时|目前|對不起|您要的|頁面|網頁|網站|伺服器|請|稍後|ページ|この|お探しの|指定された|サイト|サーバー|は|が|を|現在|一時的に|後で|もう一度|お試しください|してください|현재|페이지를|페이지가|페이지|요청하신|서비스를|사이트|서버|나중에|다시|시도해|주세요|หน้า|หน้าเว็บ|เว็บไซต์|นี้|ที่คุณ|กรุณา|ลองใหม่|抱歉|该|此|被|アクセスしようとした|ご指定の|申し訳ありませんが|요청한"""
#: The commonest function words of languages, a language a line; like BESIDE they count only where a message is.
FUNCTION_WORDS = """
i me my you he she they them his her their we us our this that these those who which what where when why how if then than as of at by for with about into through before after to from in out on off over under again once all any both each few more most other some such only own same so too very can will just should now am is are was were be been being have has had do does did doing get got seem seems appear appears let d m ll re ve don didn doesn isn wasn won couldn wouldn shouldn aren and but or because until while
ich du er sie es wir ihr mich dich ihn uns euch mir dir ihm ihnen mein dein sein unser euer der die das den dem des ein eine einer eines einem einen und oder aber wenn weil dass ob als wie wo wer was von vom zu zum zur bei beim mit nach seit aus auf an am in im für über unter vor hinter durch gegen ohne um bis war waren bin bist ist sind seid hat haben hatte wird werden wurde wurden kann können konnte muss müssen soll sollte darf gibt geht noch schon auch nur sehr hier dort bald gerade jetzt wieder dieser diese dieses kein keine
je tu il elle on nous vous ils elles me te se lui leur mon ma mes ton ta tes son sa ses notre nos votre vos leurs le la les un une des du de au aux ce cet cette ces et ou mais si car donc que qui quoi dont où quand comme dans sur sous avec sans pour par en vers chez entre depuis pendant suis es est sommes êtes sont ai as a avons avez ont avait était été être avoir ne pas plus moins très bien ici bientôt encore déjà toujours tout tous toute revenez veuillez
yo tú él ella nosotros ustedes ellos me te se nos le les lo la los las mi tu su sus nuestro nuestra un una unos unas el del al y o pero si porque que quien cual donde cuando como en a de con sin por para sobre entre hasta desde soy es son era fue ser estar estoy está están he ha hemos han había no sí más menos muy aquí pronto ya todo todos puede pueden hay tiene tienes
eu você ele ela nós eles me se nos lhe meu minha seu sua nosso nossa um uma uns umas o a os as do da dos das no na nos nas ao à e ou mas se porque que quem qual onde quando como em de com sem por para sobre entre até desde sou é são era foi ser estar está estão tem têm há não sim mais menos muito aqui já tudo todos pode
io tu lui lei noi voi loro mi ti si ci vi lo la li le mio tuo suo nostro vostro un uno una il i gli l del della dei delle al alla nel nella e o ma se perché che chi quale dove quando come in a di da con senza per su tra fra sono sei è siamo siete ho hai ha abbiamo hanno era stato stata non più meno molto qui presto già tutto tutti può riusciamo
ik jij je hij zij ze wij we jullie mij me jou hem haar ons hun mijn jouw zijn onze een de het der en of maar als omdat dat die wie wat waar wanneer hoe in op aan bij met zonder voor na door over onder tot van naar uit om te ben bent is was waren heb hebt heeft hebben had wordt worden werd kan kunnen kon moet moeten zal niet geen meer minder zeer hier er al ook nog nu
ja ty on ona my wy oni się mnie ciebie go jej nas was im mój twój swój nasz wasz ten ta to te ci i a lub albo ale jeśli bo że kto co gdzie kiedy jak w we na z ze do od po przy przed za pod nad przez dla bez jest są był była było były być mam ma mamy mają nie tak już jeszcze tylko bardzo tu tam teraz może trakcie
я ты он она мы вы они меня тебя его её нас вас их мой твой свой наш ваш вами этот эта это эти тот и а или но если потому что кто где когда как в во на с со из от до по при перед за под над через для без о об есть был была было были быть не ни да нет уже ещё еще только очень здесь там сейчас может можно нужно к ко у
jag du han hon vi ni de mig dig oss er min din sin vår denna detta det den de här där och eller men om att som vem vad var när hur i på av för med utan till från under över efter är var varit vara har hade kan kunde ska inte ingen mer redan nu alla jeg dig hun dem mit dit sit vores dette disse hvem hvad hvor når hvordan af til fra efter været have havde kunne skal ikke længere lengre nu nå alle hovsa
minä sinä hän me te he se tämä nämä ne joka mikä kuka missä milloin miten ja tai mutta jos että kun ei en et emme eivät on ovat oli olla ollut voi voit vain jo nyt tässä já ty on ona my vy oni se si tento tato toto kdo co kde kdy jak v ve na z ze do od po při před za pod nad pro bez je jsou byl byla bylo být není nejsou už ještě jen velmi zde teď a i nebo ale že
én te ő mi ti ők ez az ezt azt és vagy de ha hogy mert ki mit hol mikor van vannak volt nem már még csak itt most eu tu el ea noi voi ei ele mă te se ne vă îmi îți acest această acesta și sau dar dacă că cine ce unde când cum în la de cu fără pe pentru din este sunt era fost am ai are avem au nu mai deja aici acum
tôi bạn anh chị chúng họ này đó và hoặc nhưng nếu vì rằng ai gì đâu khi nào như ở trong trên với không được bị là có đang đã sẽ chưa rất cũng quay saya anda kamu dia kami kita mereka ini itu dan atau tetapi jika karena bahwa siapa apa mana kapan bagaimana di ke dari pada dengan tanpa untuk adalah ada sudah akan belum sangat juga beberapa saat silakan sedang ben sen o biz siz onlar bu şu ve veya ama eğer çünkü ki kim ne nerede nasıl için ile değil var yok daha çok şimdi"""
#: The words of the scrambled Latin that fills layouts.
LOREM = """lorem ipsum dolor sit amet consectetur consectetuer adipiscing adipisicing elit sed do eiusmod tempor incididunt ut labore et dolore magna aliqua enim ad minim veniam quis nostrud
exercitation ullamco laboris nisi aliquip ex ea commodo consequat duis aute irure in reprehenderit voluptate velit esse cillum eu fugiat nulla pariatur excepteur sint occaecat
cupidatat non proident sunt culpa qui officia deserunt mollit anim id est laborum
pellentesque habitant morbi tristique senectus netus malesuada fames ac turpis egestas vestibulum tortor quam feugiat vitae ultricies eget ante donec libero semper aenean mi mauris placerat eleifend leo
nec eu pretium quis sem nulla massa justo fringilla vel aliquet vulputate rhoncus imperdiet a venenatis nullam dictum felis pede integer cras dapibus vivamus elementum nisi porttitor condimentum
curabitur phasellus viverra metus varius laoreet quisque rutrum etiam augue maecenas tempus tellus faucibus tincidunt duis blandit luctus pulvinar hendrerit lorem nunc suspendisse fusce lacinia
praesent scelerisque sagittis posuere class aptent taciti sociosqu litora torquent per conubia nostra inceptos himenaeos perspiciatis unde omnis iste natus error voluptatem accusantium
doloremque laudantium totam rem aperiam eaque ipsa quae ab illo inventore veritatis quasi architecto beatae dicta explicabo"""
#: What is typed to fill a field.
MASH = "test testing asdf asdfg asdfgh asdfasdf qwerty qwertz qwert jkl jklö hjkl xxx xxxx yyy zzz blah bla blabla foo bar baz foobar abc abc123 123abc dummy tbd tba n/a aaa bbb"
#: Words of these two lists count as filler in a run of at least so many; with a typed one among them, fewer do.
FILLER_RUN, MASH_RUN = 4, 3

#: What error messages say of files, lines and tables; read as one more message.
_DETAIL = re.compile(
    r"(?:\b(?:in|file|at) )?[\"']?(?:/[\w.\-]+){2,}(?:\(\d+\))?[\"']?(?::\s*\w+\(\))?(?:,? (?:on )?line \d+)?"
    r"|\bat [\w$]+(?:\.[\w$]+)+\(\w+\.\w+:\d+\)|\b(?:in )?thread \"?\w+\"?|\btable \"\w+\"|\bon line \d+",
    re.I,
)
#: Names of hosts, which stand beside messages.
_HOST = re.compile(r"\b(?:https?://)?(?:[a-z0-9-]+\.)+(?:com|org|net|info|edu|gov|example|localhost)\b", re.I)
#: One of these is in every text with such a detail.
_TRACE = re.compile(r"/[\w.\-]+/|:\d+\)|[Oo][Nn] [Ll][Ii][Nn][Ee]|[Tt][Hh][Rr][Ee][Aa][Dd] |[Tt][Aa][Bb][Ll][Ee] \"")
_DETAILS = " kldetail "
_SPACE = re.compile(r"[^\S\n]+")
_INVISIBLE = re.compile("[­͏؜ᅟᅠ឴឵᠎​-‏‪-‮⁠-⁯︀-️﻿\x00-\x08\x0b\x0c\x0e-\x1f\x7f-\x9f]")
_WORD = regex.compile(r"[\p{L}\p{M}\p{N}]+")
_BREAKS = re.compile(r"\r\n?|[  \x85]")
_DOTS = re.compile(r"(?<=\w)\.{2,}(?=\w)")
_SEPARATORS = re.compile(r"\s*(?:[|·•»›>/\t]|::|--|\s-\s|\s–\s|\n)\s*")


def _clean(text: str) -> str:
    """Line ends as \\n, no invisible characters, compatibility forms resolved."""
    text = _DOTS.sub(".", _BREAKS.sub("\n", text))
    return _INVISIBLE.sub("", text if text.isascii() else unicodedata.normalize("NFKC", text.replace("…", " … ")))


#: What the one-byte charset of browsers reads the bytes 80 to 9f as; the five it doesn't define stay control characters.
_BYTES = {ord(c): b for b in range(0x80, 0xA0) if (c := bytes([b]).decode("cp1252", "ignore"))}
#: What the first byte of a longer UTF-8 sequence is read as.
_LEAD = re.compile(r"[\xc2-\xf4]")
_LINE = re.compile(r"[^\r\n]+")


def _repaired_line(m: re.Match) -> str:
    line = m.group()
    if not _LEAD.search(line):
        return line
    try:
        return line.translate(_BYTES).encode("latin-1").decode("utf-8")
    except UnicodeError:
        return line


def _repaired(text: str) -> str:
    """UTF-8 that was read as a one-byte charset, read as UTF-8 again line by line; anything else as it is."""
    return _LINE.sub(_repaired_line, text) if not text.isascii() and _LEAD.search(text) else text


def _read(text: str) -> str:
    """Repaired before it is cleaned, which would remove or rewrite what bytes of garbled lines are read as."""
    return _clean(_repaired(text))


# --- placeholders ---------------------------------------------------------------------------------------------------------


def placeholder(text: str | None) -> str | None:
    """The first placeholder that stands unfilled in a text; None where there is none."""
    text = _read(text or "")
    return _placeholder_in(text) if _SIGNS.search(text) else None


def _placeholder_in(text: str) -> str | None:
    bare = re.sub(r"(?m)^\s*undefined\s*$", "[object Object]", text)
    for sentence in _SENTENCE.split(bare):
        if not sentence or not _SIGNS.search(sentence):
            continue
        for m in _PLACEHOLDER.finditer(sentence):
            before, after = sentence[: m.start()], sentence[m.end() :]
            if before[-1:] and before[-1] in _OPEN and (before[-1] == "\\" or after[:1] and after[0] in _CLOSE):
                continue
            sign = m.group()
            if m.group("open") and not _field(sign) and not _value_belongs(sign, before, after):
                continue
            if sign == "undefined" and (_PREDICATE.search(before) and _CLOSED.match(after) or _NOUN.match(after) or _ATTRIBUTE.search(before) and re.match(r" \w", after) or _MATH.search(sentence)):
                continue
            if sign in ("%s", "%d") and _CODE.search(before):
                continue
            if sign[0] == "{" and _MATH.search(before + " " + after):
                continue
            if ABOUT.search(before + " " + after):
                continue
            return sign
    return None


@lru_cache(maxsize=1)
def _fields() -> frozenset[str]:
    return frozenset(FIELDS.casefold().split())


def _field(sign: str) -> bool:
    """Whether what brackets hold is a field's name: a word of FIELDS, or in braces and the like several joined as programs write them."""
    if LABELS.fullmatch(sign):
        return False
    words = re.findall(r"[A-Z]?[^\W\d_A-Z]+|[A-Z]+(?![a-z])|\d+", sign.replace("&lt;", "").replace("&gt;", ""))
    inner = sign.strip("[]{}$~<>«»")
    if sign.startswith("&lt;") and sign[4:-4].casefold() in TAGS:
        return False
    if any(w.casefold() in _fields() for w in words):
        return True
    if sign[0] == "[" and sign[1] != "[":
        return sign.isupper() and any(len(w) >= 6 and w.casefold() not in DIRECTIONS for w in words)
    if sign[0] == "[" and inner != inner.lower():  # wiki links join words so, too
        return bool(re.match(r"[a-z]{3,}[A-Z]", inner))
    return bool(re.search(r"[^\W\d_][_.][^\W\d_]|[a-z][A-Z]", inner))


def _value_belongs(sign: str, before: str, after: str) -> bool:
    """Whether a sign stands where only a value can: behind a greeting or a label, or before what follows a number or a name."""
    if LABELS.fullmatch(sign) or sign[0] == "[" and sign[1] != "[" and not sign.isupper():
        return False
    if sign.startswith("&lt;") and sign[4:-4].casefold() in TAGS:
        return False
    labelled = before.rstrip().endswith((":", "："))
    if labelled and sign[0] == "[" and sign[1] != "[":
        label = re.findall(r"\w+", before[-40:])
        labelled = bool(label) and label[-1].casefold() in _fields()
    return bool(labelled or VALUE_AFTER.search(before) or VALUE_BEFORE.match(after))


# --- messages -------------------------------------------------------------------------------------------------------------


def _words(text: str) -> str:
    # capitals of Turkish don't tell i and dotless i apart
    return " ".join(_WORD.findall(text.casefold().replace("\u0307", "").replace("ı", "i")))


def _plain(words: str) -> str:
    """Without what isn't ASCII: the same for a text that lost its accents to a wrong charset."""
    return " ".join(re.sub(r"[^\x00-\x7f]+", " ", words).split())


def _entries(listed: str) -> dict[str, str]:
    """Every entry of a list as words, its slots filled in; its plain form beside it where that still says enough."""
    fill = {"{n}": _NOUNS, "{t}": _THINGS, "{s}": _SCRIPTS, "{u}": _USES, "{v}": _ACTS}
    fill = {k: v.split("|") for k, v in fill.items()}
    found: dict[str, str] = {}
    for entry in listed.replace("\n", "|").split("|"):
        if not entry.strip():
            continue
        slots = [s for s in fill if s in entry]
        for values in product(*(fill[s] for s in slots)):
            filled = entry
            for s, v in zip(slots, values):
                filled = filled.replace(s, v)
            words = _words(filled)
            found[words] = words
            plain = _plain(words)
            if len(plain) >= 12 and len(plain) >= 0.7 * len(words):
                found.setdefault(plain, words)
    return found


@lru_cache(maxsize=1)
def phrases() -> dict[str, str]:
    """Every message as words."""
    return _entries(MESSAGES + MORE_MESSAGES + CORES)


@lru_cache(maxsize=1)
def _messages() -> ahocorasick.Automaton:
    """Messages, and the mark of details."""
    made = ahocorasick.Automaton(ahocorasick.STORE_LENGTH)
    for words in [*phrases(), _DETAILS.strip()]:
        made.add_word(words)
    made.make_automaton()
    return made


@lru_cache(maxsize=1)
def _beside() -> ahocorasick.Automaton:
    """What stands beside messages."""
    made = ahocorasick.Automaton(ahocorasick.STORE_LENGTH)
    for words in [*_entries(BESIDE), *(_words(w) for w in FUNCTION_WORDS.split())]:
        if words:
            made.add_word(words)
    made.make_automaton()
    return made


@lru_cache(maxsize=1)
def _lists() -> tuple[frozenset[str], frozenset[str], frozenset[str]]:
    menus = frozenset(x for x in (_words(e) for e in MENUS.replace("\n", "|").split("|")) if x)
    buttons = frozenset(x for x in (_words(e) for e in BUTTONS.replace("\n", "|").split("|")) if x)
    return menus | buttons, frozenset(_words(LOREM).split()), frozenset(_words(MASH).split())


def _only(line: str, allowed: frozenset[str]) -> bool:
    """Whether a line consists of these entries, with separators or blanks between them."""
    for part in _SEPARATORS.split(line):
        words = _words(part).split()
        i = 0
        while i < len(words):
            for n in range(min(4, len(words) - i), 0, -1):
                if " ".join(words[i : i + n]) in allowed:
                    i += n
                    break
            else:
                return False
    return True


def _boilerplate(line: str) -> bool:
    """Footers and rules."""
    return not _WORD.search(line) or bool(FOOTERS.search(line))


def _messages_only(words: str) -> bool:
    """Whether messages cover these words as far as a text's must be covered."""
    marks = _covered(words)
    return sum(1 for c, m in zip(words, marks) if m == 1 and c != " ") >= COVERED * len(words.replace(" ", ""))


def _without_notice(line: str) -> str:
    """A line without its cookie notice: the sentences that speak of cookies, unless they are messages, and menus and buttons beside them."""
    if len(line) >= 300 or not COOKIES.search(line):
        return line
    menus, kept = _lists()[0], []
    for sentence in _SENTENCE.split(line):
        parts = [x for x in _SEPARATORS.split(sentence) if not _only(x, menus)]
        words = _words(" ".join(parts)).split()
        for n in range(min(4, len(words) - 1), -1, -1):
            if (not n or " ".join(words[:n]) in menus) and words[n:] and _messages_only(" ".join(words[n:])):
                kept.append(" ".join(words[n:]))
                break
        else:
            if words and not COOKIES.search(sentence) and not NOTICES.search(sentence):
                kept.append(" ".join(parts))
    return " ".join(kept)


def _one_script(a: str, b: str) -> bool:
    """Whether two neighbouring characters are parts of one word (scripts without blanks have no such words)."""
    return a.isalnum() and b.isalnum() and a < "฀" and b < "฀"


def _whole(words: str, start: int, end: int) -> bool:
    """Whether no word is cut at either end of a match."""
    return not (start and _one_script(words[start - 1], words[start]) or end + 1 < len(words) and _one_script(words[end], words[end + 1]))


def _covered(words: str) -> bytearray:
    """A mark of 1 for each character that a message, a run of filler words or a number beside these covers."""
    marks = bytearray(len(words))
    for end, n in _messages().iter(words):
        if _whole(words, end - n + 1, end):
            marks[end - n + 1 : end + 1] = b"\1" * n
    _, lorem, mash = _lists()
    at, run, typed = 0, [], False
    for word in [*words.split(" "), ""]:
        if word in lorem or word in mash:
            run.append((at, at + len(word)))
            typed |= word in mash
        else:
            if len(run) >= (MASH_RUN if typed else FILLER_RUN):
                for a, b in run:
                    marks[a:b] = b"\1" * (b - a)
            run, typed = [], False
        at += len(word) + 1
    if any(marks):
        _number(words, marks)
    return marks


def _number(words: str, marks: bytearray) -> None:
    """Marks numbers beside what is marked: codes, line numbers."""
    for m in re.finditer(r"\b(?:[0-9a-f]*\d[0-9a-f]*|[a-f]{3,8})\b", words):
        a, b = m.span()
        near = [x for x in ((marks[a - 2] if a > 1 else 0), (marks[b + 1] if b + 1 < len(words) else 0)) if x]
        if near:
            marks[a:b] = bytes(x or min(near) for x in marks[a:b])


def _with_beside(words: str, marks: bytearray) -> bytearray:
    """The marks, and 2 where only words cover that stand beside messages."""
    full = bytearray(marks)
    for end, n in _beside().iter(words):
        start = end - n + 1
        if 0 in full[start : end + 1] and _whole(words, start, end):
            full[start : end + 1] = bytes(m or 2 for m in full[start : end + 1])
    _number(words, full)
    return full


def _with_messages(line: str, part: str, own: bytearray) -> bytearray:
    """The marks of a line, less those of words beside messages in sentences that hold no message but other words."""
    at, kept = 0, bytearray(own)
    for sentence in _SENTENCE.split(line):
        words = _words(sentence)
        end = at + len(words)
        if words and part[at:end] == words:
            marks = own[at:end]
            if 1 not in marks and any(not m for c, m in zip(words, marks) if c != " "):
                kept[at:end] = bytes(len(words))
            at = end + 1
    return kept


def message_cover(text: str | None) -> float:
    """The part of a text's letters and digits, without menus, cookie notices, footers and titles, that messages cover.

    0 where no message is found, and for null, empty and blank texts.
    """
    return _cover_in(_read(text)) if text and not text.isspace() else 0.0


def _cover_in(text: str) -> float:
    text = _repaired(html.unescape(text))
    words = _words(text)
    if next(_messages().iter(words), None) is None and not _filler(words):
        return 0.0
    text = _SPACE.sub(" ", text)
    if _TRACE.search(text):
        text = _DETAIL.sub(_DETAILS, text)
    text = _HOST.sub(" klhost ", text)
    lines = [line for line in (_without_notice(x.strip()) for x in text.split("\n")) if line and not _boilerplate(line)]
    parts = [_words(line) for line in lines]
    words = " ".join(parts)
    if not words:
        return 0.0
    marks = _covered(words)
    if not any(marks):
        return 0.0
    menus = _lists()[0]
    at, titles, core, kept = 0, 0, 0, []
    for line, part in zip(lines, parts):
        covered = marks[at : at + len(part)].count(1)
        size = len(part.replace(" ", ""))
        start, at = at, at + len(part) + 1
        if covered < size and _only(line, menus):  # covered menu entries are parts of a message that runs over lines
            continue
        if not covered and titles < TITLES and len(part.split()) <= TITLE_WORDS and not re.search(r"[.!?;:。！？]\s*$|\d", line):
            titles += 1
            continue
        kept.append((line, part, start, size))
        core += covered
    whole = sum(size for *_, size in kept)
    if core <= SAID * whole:
        return 0.0
    marks, said = _with_beside(words, marks), 0
    for line, part, start, _ in kept:
        own = _with_messages(line, part, marks[start : start + len(part)])
        said += sum(1 for c, m in zip(part, own) if m and c != " ")
    return said / whole


def _filler(words: str) -> bool:
    """Whether enough filler words are among these for a run of them."""
    _, lorem, mash = _lists()
    return sum(1 for w in words.split() if w in lorem or w in mash) >= MASH_RUN


def verdict(text: str | None, covered: float = COVERED) -> str | None:
    """'placeholder', 'residue' or None for a text to keep."""
    if not text or text.isspace():
        return None
    text = _read(text)
    if _SIGNS.search(text) and _placeholder_in(text):
        return "placeholder"
    return "residue" if _cover_in(text) >= covered else None


def judge(docs: DataFrame, key: str, text: str, covered: float = COVERED) -> DataFrame:
    """(key, verdict STRING) of each row: 'placeholder', 'residue' or null.

    Null, empty and blank texts have null; texts are read whole, bytes that aren't UTF-8 as U+FFFD; repeated rows come out as often as they go in; other columns are ignored.
    """
    schema = T.StructType([T.StructField(key, docs.schema[key].dataType), T.StructField("verdict", T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [verdict(x, covered) for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.string())], names=[key, "verdict"])

    return docs.select(key, F.make_valid_utf8(F.col(text).cast("string"))).mapInArrow(run, schema)
