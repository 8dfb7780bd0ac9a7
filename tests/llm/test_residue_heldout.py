"""Texts written from general knowledge of web pages, not from any corpus of this project: how much is found, and how much of what is found is right.

The first three sets (UNFILLED, NOTHING, REAL; LATER_..., THIRD_...) were in view while the rules took their form: they show that known
kinds of text behave, not how unseen ones do. The last (UNSEEN_...) was written after the rules were done, was measured before
and after a general list of function words came in, and no rule was changed for it; all figures are in the README. Its recall is low for
pages without content: phrases that nobody listed aren't found.
"""

import pytest

from kithloom.llm import residue as R

UNFILLED = """Dear {{customer.first-name}}, thank you for your order.
Hallo {Vorname}, schön dass du da bist.
Bonjour {prénom}, votre commande est prête.
Здравствуйте, {{имя}}! Ваш заказ принят.
Order #${orderNumber} has shipped.
Your code is %CODE%.
Hi *|FNAME|*, here is our newsletter.
Hi [First Name], here is our newsletter.
[Your Company Name] is pleased to invite you.
Published on {{ page.date | date: '%Y' }} by {{ page.author }}.
Only {count} left in stock.
<%= @user.name %> wrote a comment.
Welcome, {{ user?.name }}
{% block content %}{% endblock %}
You have {0} new messages.
Dear <<Name>>, we write to you about your contract.
Sehr geehrter Herr «Nachname», wir danken für Ihr Schreiben.
Hello {!Contact.Name}, your case was closed.
##FIRSTNAME##, only two days left!
Hi %recipient.name%, welcome aboard.
{$page_title}
您好,{{姓名}},您的订单已发货。
The meeting takes place on [insert date] in the town hall.
Best bakery in [ENTER CITY]
Estimado {nombre}, su pedido ha sido enviado.
Price: {{ cart[0].price }} EUR
Total {{ x }} items in {{ user-name }}'s basket
Welcome back, undefined! You have undefined points.
Posted by [object Object] on Monday
© {{ currentYear }} All rights reserved. We bake bread in the old mill since 1901.
The best offers of {month} {year}
Call us at {{phone}} or visit our shop near the harbour.
Our address: __ADDRESS__
Ciao {nome}, il tuo ordine è in viaggio.
Witaj {imię}, dziękujemy za zakupy.""".split("\n")

NOTHING = """404\\nOops! That page can't be found.\\nIt looks like nothing was found at this location. Maybe try a search?
403 Forbidden\\nnginx
503 Service Temporarily Unavailable\\nnginx/1.14.2
502 Bad Gateway\\nnginx/1.18.0 (Ubuntu)
Error 522\\nConnection timed out
This page isn't working\\nexample.com redirected you too many times.
This site can’t be reached\\nexample.com took too long to respond.\\nERR_CONNECTION_TIMED_OUT
Service Unavailable\\n\\nHTTP Error 503. The service is unavailable.
Sorry, you have been blocked\\nYou are unable to access this site
Just a moment...\\nChecking if the site connection is secure
Attention Required! | Cloudflare
You need to enable JavaScript to run this app.
This website requires JavaScript. Please enable it in your browser settings.
We're sorry but my-app doesn't work properly without JavaScript enabled. Please enable it to continue.
Site temporarily unavailable due to scheduled maintenance. Please check back later.
Briefly unavailable for scheduled maintenance. Check back in a minute.
Internal Server Error\\nThe server encountered an internal error or misconfiguration and was unable to complete your request.
Not Found\\nThe requested URL was not found on this server.\\nApache/2.4.41 (Ubuntu) Server at example.org Port 80
Sorry, the page you were looking for doesn't exist.
Database connection failed. Please try again later.
Our new website is coming soon. Stay tuned!
This account has been suspended.
Welcome to nginx!\\nIf you see this page, the nginx web server is successfully installed and working. Further configuration is required.
Session timeout. Please log in to continue.
Pellentesque habitant morbi tristique senectus et netus et malesuada fames ac turpis egestas.
Donec quam felis, ultricies nec, pellentesque eu, pretium quis, sem. Nulla consequat massa quis enim.
Whoops, looks like something went wrong.
The requested resource could not be found. Error code: 404
Hoppla! Diese Seite konnte nicht gefunden werden.
Diese Website benötigt JavaScript. Bitte aktivieren Sie JavaScript in den Einstellungen Ihres Browsers.
Die Website befindet sich derzeit im Wartungsmodus.
Oups ! Cette page est introuvable.
Ce site est en cours de maintenance. Merci de revenir plus tard.
JavaScript est désactivé dans votre navigateur.
Lo sentimos, la página que busca no existe.
Estamos realizando tareas de mantenimiento. Disculpe las molestias.
Spiacenti, la pagina che cerchi non esiste.
Desculpe, a página que procura não existe.
Sorry, deze pagina kan niet worden gevonden.
Przepraszamy, strona nie została znaleziona.
Ошибка 404. К сожалению, запрашиваемая страница не найдена.
Sidan kunde inte hittas
Du måste aktivera JavaScript för att använda denna sida.
Siden blev ikke fundet
Beklager, siden finnes ikke.
Sivua ei löytynyt
Palvelu on tilapäisesti pois käytöstä.
Stránka nenalezena
Pro zobrazení stránky povolte JavaScript.
Az oldal nem található
Pagina nu a fost găsită
Không tìm thấy trang
Halaman tidak ditemukan
Сторінку не знайдено
Aradığınız sayfa bulunamadı.
このページを表示するにはJavaScriptを有効にしてください。
找不到網頁
您的瀏覽器不支援 JavaScript
요청하신 페이지가 존재하지 않습니다.
عذرا، الصفحة غير موجودة
ไม่พบหน้าที่คุณต้องการ
הדף לא נמצא""".split("\n")

REAL = """The committee met for an undefined period of time and left without a vote.
[LAUGHTER] And then he left the stage. [APPLAUSE]
The [NATO] summit was moved to Vilnius.
See [[Paris]] and [[Lyon]] for the railway's history.
~~sale~~ The offer ended on Sunday.
Use &lt;br&gt; for a line break and &lt;strong&gt; for emphasis.
$alpha$ and $beta$ are the angles of the triangle.
Draw two {green} and three {blue} cards to finish the round.
JavaScript is a language that every browser understands, and it turned thirty this year.
The 404 bus stops near the page turner's house.
Access was denied to journalists who wanted to visit the camp.
How to fix error 503: restart the service, then look at the log.
Lorem ipsum is a dummy text that printers have used since the sixteenth century.
The museum is closed for maintenance until May. Tickets remain valid.
Page not found errors cost shops money, a study of the chamber of commerce says.
In Jinja, {{ name }} prints a variable.
A gallon costs $5 today, 20% more than last year.
Write printf("%s\\n", name); and compile the program.
Gallia est omnis divisa in partes tres, quarum unam incolunt Belgae, aliam Aquitani.
Closed on Mondays.
Coming soon: the new film about the lighthouse keeper opens in March.
Sorry, all tickets for the concert are sold out.
We service your boiler once a year and keep it in good repair.
Wartungsarbeiten an der Brücke beginnen im Mai und dauern drei Wochen.
Accès refusé, le nouveau roman de l'auteur, sort mercredi en librairie.
The mayor apologised for the inconvenience and promised that the road would open in June.
Let {a, b} be an edge of the graph; then {b} is a leaf.
The array is indexed as a[0], and its length is undefined before it is filled.
He wrote "404 Not Found" on the door of the abandoned shop.
We baked bread in the old mill. We use cookies. Accept
The band [US] played with guests from [UK] and [EU].
Her blog about template engines explains why {{ title }} must be escaped.
My grandmother said: test the soup, test it again, and then serve it.
No results for the election were published before midnight.
The server brought the soup, and an error in the bill was soon corrected.
Under construction since 2019, the bridge will carry trams and bicycles.
Your session with the therapist can be moved up to a day before.
Please enable subtitles in the player to follow the dialogue.
The password must hold eight characters and one digit.
Sidan 12 i boken handlar om fisket i Bohuslän.
Halaman rumah itu luas dan penuh bunga.
Az oldal tetején a város címere látható.
Pagina a treia a ziarului prezintă vremea.
[PDF] Annual report of the harbour authority
[1] Smith, J. The history of glass. [2] Jones, A. Sand and soda.
[12:30] Anna: are you coming? [12:31] Ben: yes
The temperature is 20 °C {according to the old station}.
"Dear {name}" is how the letter began, which made everybody laugh.
x_{10} + y^{ab} = z
The password reset mail greets users with Hello %s in old versions of the program, a bug that was fixed in spring.
Choose between <left> and <right> arrows to steer the ship.
Set ${JAVA_HOME} in the shell before the compiler is started.""".split("\n")


LATER_UNFILLED = """Dear {{ contact.firstname | default: "friend" }}, we miss you!
Liebe {{ anrede }}, hier ist dein Gutschein.
Bonjour [Prénom], merci de votre inscription.
Hello %FIRST_NAME%, your parcel is on its way.
Rechnung Nr. ${invoice.number} vom ${invoice.date}
Gentile {cognome}, la sua prenotazione è confermata.
Olá {{nome_cliente}}, tudo bem?
Your appointment: [DATE] at [TIME]
We are [Company Name], experts in roofing.
Hi {{user_first_name}}! Rate your stay at {{hotel.name}}.
Sold by {seller_name} since {year}
<%= product.title %>
Уважаемый {{ФИО}}, напоминаем о встрече.
親愛なる{{氏名}}様
{{{body}}}
Click here to unsubscribe: *|UNSUB|*
Last updated: {date}
Call [Phone Number] for a free quote.
Weather in {city}: sunny
{{ $t('home.headline') }}
Results for "{{ query }}"
Showing {0} to {1} of {2} entries
Hola {{1}}, tu cita es el {{2}}.
Merhaba {isim}, hoş geldin!
Copyright {{ site.time | date: "%Y" }} Harbour Museum. Open daily.""".split("\n")

LATER_NOTHING = r"""HTTP Status 404 – Not Found\nApache Tomcat/9.0.31
Error 1020\nAccess denied
400 Bad Request\nRequest Header Or Cookie Too Large\nnginx
Error: Server Error\nThe server encountered an error and could not complete your request. Please try again in 30 seconds.
Gateway Timeout\nThe gateway did not receive a timely response from the upstream server.
Something went wrong. Try reloading the page.
Hmm. We’re having trouble finding that site.
Page Not Found. The link you followed may be broken, or the page may have been removed.
The site is currently undergoing maintenance. We'll be back soon!
This site is under construction.
This store is unavailable
Sorry, this content isn't available right now.
This video is unavailable
Too Many Requests. Rate limited. Please slow down.
Please turn JavaScript on and reload the page.
JavaScript is not available. We’ve detected that JavaScript is disabled in this browser.
Please enable JS and disable any ad blocker
This application requires JavaScript to be enabled.
Your session has expired. Please refresh the page.
Unauthorized. This server could not verify that you are authorized to access the document requested.
Notice: Undefined variable: page in /var/www/html/index.php on line 42
Warning: mysql_connect(): Access denied for user 'root'@'localhost'
Class aptent taciti sociosqu ad litora torquent per conubia nostra, per inceptos himenaeos.
Sed ut perspiciatis unde omnis iste natus error sit voluptatem accusantium doloremque laudantium.
Seite wurde nicht gefunden
Der angeforderte Inhalt ist leider nicht mehr verfügbar.
Sie müssen JavaScript aktivieren, um diese Seite zu nutzen.
Erreur 500 : une erreur interne s'est produite.
Vous devez activer JavaScript pour utiliser ce site.
Página en construcción
No tienes permiso para ver esta página.
Página em manutenção. Volte em breve.
Errore 403: accesso vietato
De server is tijdelijk onbereikbaar.
Podana strona nie istnieje
Доступ к сайту временно ограничен
Sidan är tillfälligt nere
Siden er under opbygning
Sivusto on huollossa
Omlouváme se, stránka nebyla nalezena.
A weboldal karbantartás alatt van.
Eroare 404 - pagina nu a fost gasita
Trang này không tồn tại
Situs sedang dalam pemeliharaan
404 页面未找到
对不起,您要访问的页面不存在
ページが存在しません
현재 페이지를 사용할 수 없습니다
الصفحة المطلوبة غير متوفرة
Η σελίδα που ζητήσατε δεν υπάρχει""".split("\n")

LATER_REAL = """The term remains undefined in the statute.
Undefined behaviour is what makes the language fast and dangerous.
[MUSIC PLAYING] Narrator: the harbour wakes up.
Anna: [LAUGHTER] No, never.
Members of the [BBC] and the [WHO] were present.
The page [[Main Page]] links to [[Help:Contents]].
Prices fell from ~~40~~ 30 euros.
In HTML, &lt;title&gt; holds the title of a page.
We write $n$ for the size and $x$ for its root.
Mix {red} with {blue} and you get purple, says the colour chart.
The variable {x} runs from one to ten.
Our developers moved the shop from PHP to JavaScript last year.
A 500 error kept voters from registering on the last day, the ministry admitted.
Not found in the wild since 1936, the thylacine lives on in museums.
Access denied is a thriller set in Lisbon.
The bridge is temporarily unavailable to lorries over seven tonnes.
We are sorry to announce the death of our founder.
Please try again later, the shop assistant told her, and she did.
Test your soil before planting: one test in spring, one in autumn.
Arma virumque cano, Troiae qui primus ab oris Italiam fato profugus Laviniaque venit litora.
Nemo enim ipsam voluptatem quaerit, said the professor of classics, quoting the author correctly for once.
Foo Fighters and the Bar Kays played in Basel.
Die Seite drei der Zeitung zeigt den neuen Hafen.
Der Server im Keller des Rathauses wurde ersetzt.
Cette page du journal intime raconte la guerre.
Esta página del diario cuenta la historia del faro.
Страница истории нашего города началась в 1703 году.
この本のページは手作りの紙でできています。
这一页介绍了博物馆的历史。
Fel i boken: på sidan 40 ska det stå 1912.
Back to the start: how the club was founded again.
The request was denied because the form was incomplete.
Ask for an example text at the library desk.
Maintenance of the organ takes two weeks each year.
Service is unavailable on public holidays; trains run every hour otherwise.
Open hours
Sold
Use %s for strings and %d for numbers in the format string.
In Liquid templates, {{ product.price }} is replaced by the price.
Write {{ "{{" }} to escape braces in the template.
The set {name, age} is a key of the table.
Mr. Webb [sic] wrote to the council [emphasis added].
The song [Live] was recorded in [Oslo].
Wait [a moment], she said [laughs].
Error bars show one standard deviation.""".split("\n")


THIRD_UNFILLED = r"""Hello {{ subscriber.name }}! Your weekly digest is here.
Guten Tag {{Kundenname}}, Ihre Rechnung ist da.
Cher {{ client.prenom }}, votre colis est arrivé.
Your verification code: %%code%%
Hi ${user.displayName}, you have a new follower.
Invoice no. {invoice_no} is due on {due_date}.
[Insert company logo]
<%= yield :sidebar %> Opening hours and directions
Estimada {{nombre}}, gracias por su compra.
尊敬的{{客户姓名}},您好!
Bem-vindo, {{ usuario }}!
{{header}}
Posted by {author} in {category}
##ORDER_ID## has been shipped
Meet us at __VENUE__ on __DATE__
Total: {$total} EUR
Dear [Recipient Name], it was a pleasure to meet you.
Sincerely, [Your Name]
Prices from undefined per night
{% if user %}{{ user.email }}{% endif %}""".split("\n")

THIRD_NOTHING = r"""Error 404\nThe page you are trying to reach does not exist, or has been moved.
410 Gone
HTTP Error 500.19 - Internal Server Error
504 Gateway Time-out\nThe server didn't respond in time.
We could not process your request. Please contact support.
An application error occurred on the server.
The website is temporarily unable to service your request.
Oh no! Something broke on our end.
Sorry, we couldn't find what you were looking for.
This page has been deleted.
No such page exists.
This listing has expired.
You must be logged in to view this page.
Please verify you are a human
Cookies must be enabled to view this site.
Scripts are blocked. Allow scripts to continue.
To use this site, switch on JavaScript in your browser.
Website under maintenance, please visit us later.
Your text goes here. Your text goes here.
Add your description here
Nam libero tempore, cum soluta nobis est eligendi optio cumque nihil impedit quo minus.
Ut enim ad minim veniam, quis nostrud exercitation ullamco laboris nisi ut aliquip ex ea commodo consequat.
Der Server ist momentan überlastet. Bitte versuchen Sie es in einigen Minuten erneut.
Ihr Zugriff wurde blockiert.
Ce contenu n'est plus accessible.
Le site est actuellement fermé pour maintenance.
Esta página ha sido eliminada.
El servicio no está disponible en este momento.
Não foi possível encontrar a página.
La pagina è stata rimossa.
Deze pagina is verwijderd.
Wystąpił problem z wyświetleniem strony.
Эта страница была удалена.
Проверьте правильность адреса. Страница не найдена.
Vi kan inte hitta sidan du letar efter.
Vi kunne ikke finde siden.
Etsimääsi sivua ei löytynyt.
Požadovaná stránka neexistuje.
A kért oldal nem elérhető.
Pagina căutată nu există.
Rất tiếc, đã có lỗi xảy ra.
Maaf, halaman yang Anda minta tidak ada.
İstediğiniz sayfaya ulaşılamıyor.
该页面已被删除
抱歉,服务器开小差了
アクセスしようとしたページは削除されました
요청하신 페이지를 찾지 못했습니다
عذرًا، لم يتم العثور على الصفحة""".split("\n")

THIRD_REAL = r"""Harbour café, open from nine to five.
We have moved to Mill Street 4.
The error was found by a pupil and corrected in the next edition.
An undefined quantity of grain was left in the barn.
The site of the old abbey was found beneath the car park.
Requests for guided tours must be made in writing.
The server carried four plates and did not drop one.
[CHEERS] [MUSIC] The band walks on stage.
See also [[Glass]] and [[Window]].
Angles $theta$ and $phi$ are equal.
Swatches: {teal}, {navy} and {mustard}.
Wrap the text in &lt;em&gt; to stress it.
This document has been translated from Danish.
Maintenance engineer wanted, full time, immediate start.
The link between smoking and cancer was denied for decades.
The service on Sunday begins at ten; please be on time.
The file was found in an attic and contains letters of the poet.
Your browser history tells advertisers more than you think, researchers found.
JavaScript for beginners: evening course, eight lessons, room 12.
The domain of the function is the set of all real numbers.
Access to the beach is denied to dogs from May to September.
Der Inhalt der Truhe wurde auf dem Markt verkauft.
Le site archéologique est fermé le lundi.
La página web del museo muestra sus cuadros.
Сервер театра подал чай гостям.
この町のサーバーは喫茶店の店長です。
该博物馆的内容十分丰富,欢迎参观。
Odi et amo. Quare id faciam fortasse requiris. Nescio, sed fieri sentio et excrucior.
Room 404 is being painted.
They tried again later and won.
Coming soon
The template of the letter is kept in drawer three.
Write %s where the name should go, the manual says.
A {year} placeholder is replaced when the template is rendered.
Timeout was called with two seconds left, and the home team scored.
Closed for the season. See you in April!
Blocked roads delayed the bus by an hour.
Out of order: the lift in building C.
The museum is offline, in the best sense: no screens, only objects.
The invoice expired in June, so the club paid a fee.""".split("\n")


UNSEEN_UNFILLED = r"""Hello {{ firstName }}, your trial ends tomorrow.
Sehr geehrte Frau {Nachname}, anbei der Vertrag.
Bonsoir {{utilisateur}}, voici vos messages.
Estimado cliente {{ cliente.nombre }}, su factura vence el {{ factura.fecha }}.
Price per night: {price_per_night}
Welcome to %SITE_NAME%
Hi @@FirstName@@, thanks for joining.
[Insert event name here]
Your order #{order.id} was delivered.
Written by [Author Name] on [Date]
{{ 'footer.copyright' | translate }}
Drogi {{ imie }}, oto Twój kod.
${title}
Hello null and welcome, [object Object].
Hurry, only %d seats left!""".split("\n")

UNSEEN_NOTHING = r"""401 Authorization Required\nnginx
Sorry! The page you requested cannot be displayed.
Oops, you've found a dead link.
Server is busy. Please try again in a moment.
We're performing some maintenance at the moment.
This group is private. Sign in to see its content.
Your request was rejected by the firewall.
The article you are looking for has been archived or removed.
Javascript seems to be disabled in your browser.
For the best experience turn on Javascript in your browser.
Parking page: this domain was recently registered.
Neque porro quisquam est, qui dolorem ipsum quia dolor sit amet, consectetur, adipisci velit.
Your headline here. Your subheadline here.
Die von Ihnen gewünschte Seite gibt es nicht.
Wir arbeiten gerade an unserer Website. Bitte schauen Sie bald wieder vorbei.
Nous n'avons pas trouvé la page que vous cherchez.
Site en construction, revenez bientôt.
La página solicitada no pudo ser encontrada.
Tu navegador tiene JavaScript desactivado.
Ocorreu um erro inesperado. Tente novamente.
Non riusciamo a trovare la pagina richiesta.
Er is een technische storing.
Strona w trakcie przebudowy. Zapraszamy wkrótce.
Запрашиваемая вами страница удалена или перемещена.
Det här innehållet är inte tillgängligt.
Hovsa, siden findes ikke længere.
Sivustoa päivitetään, palaa myöhemmin.
Web je v rekonstrukci.
Hiba: a lap nem található.
Ne pare rău, pagina căutată nu a fost găsită.
Trang web đang được bảo trì, vui lòng quay lại sau.
Server sedang sibuk, silakan coba beberapa saat lagi.
Sunucuya bağlanılamadı.
网站正在升级维护,请稍后访问
ただいまサーバーが混み合っています。
일시적인 오류가 발생했습니다. 다시 시도해 주세요.
الموقع مغلق للصيانة
האתר אינו זמין כרגע""".split("\n")

UNSEEN_REAL = r"""Bridge closed: walkers take the ferry from pier two.
The page boy brought a letter to the queen.
A dead link in the chain broke, and the anchor was lost.
The store is busy on Saturdays, so come early.
She could not find her glasses and missed the train.
The committee removed the clause about parking.
Error margins of two percent are usual in such polls.
He asked for the name, the date and the price.
The museum has been closed since the flood and will move to the old mill.
The domain was owned by the abbey until 1803.
The firewall between house and barn is made of brick.
{1, 2, 3} is a set of three numbers.
[APPLAUSE AND LAUGHTER] Thank you, thank you.
Use the [[sandbox]] for tests.
The file cabinet was moved to the second floor.
Please visit our shop at the harbour or call us.
Unfortunately the concert had to be cancelled because the singer was ill.
Der Zugriff der Polizei erfolgte am Morgen.
La construction du pont avance plus vite que prévu.
El servicio de autobuses llega tarde los lunes.
Страница за страницей он читал письма деда.
服务器这个词在餐厅里指端菜的人。
Your text must not be longer than two pages, the jury says.
Try our soup.
Username and password are printed on the card you got by post.
The number you have dialled belongs to the bakery now.
Quousque tandem abutere, Catilina, patientia nostra?
Costs: $200 for members, $250 for guests.
Dear readers, thank you for your letters.
We are closed today. Open again tomorrow at nine.""".split("\n")


def found(texts):
    return [R.verdict(t.replace("\\n", "\n")) is not None for t in texts]


@pytest.mark.parametrize(
    "sets, least",
    [((UNFILLED, NOTHING, REAL), 0.9), ((LATER_UNFILLED, LATER_NOTHING, LATER_REAL), 0.9), ((THIRD_UNFILLED, THIRD_NOTHING, THIRD_REAL), 0.9), ((UNSEEN_UNFILLED, UNSEEN_NOTHING, UNSEEN_REAL), 0.35)],
    ids=["known", "later", "third", "unseen"],
)
def test_recall_and_precision(sets, least):
    got = [found(x) for x in sets]
    hit = sum(got[0]) + sum(got[1])
    recall, precision = hit / (len(sets[0]) + len(sets[1])), hit / (hit + sum(got[2]))
    missed = [t for ts, g in zip(sets[:2], got) for t, x in zip(ts, g) if not x]
    wrong = [t for t, x in zip(sets[2], got[2]) if x]
    print([(sum(g), len(g)) for g in got], recall, precision, missed, wrong, sep="\n")
    assert recall >= least and precision >= 0.9
