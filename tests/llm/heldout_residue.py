"""Texts written after the rules of ``tidegrid.llm.residue`` were fixed, to measure them.

None is from the test documents. RESIDUE holds messages as servers, browsers, content
systems and frameworks show them, filler and unfilled templates; ORDINARY holds texts
that use the same words or signs for something else. ``residue_texts`` and
``ordinary_texts`` add each text once more in other surroundings.
"""

ERRORS = """
Error establishing a database connection
This site can't be reached. The connection was reset. Try checking the connection or running network diagnostics.
The server is temporarily unable to service your request due to maintenance downtime or capacity problems. Please try again later.
Service Unavailable. The server is temporarily unable to service your request.
The requested URL was not found on this server. That's all we know.
The requested URL /reports/q3 was not found on this server. Apache Server at example.org Port 443
You don't have permission to access this resource.
Forbidden. You don't have permission to access /private/ on this server.
Sorry, the page you are looking for could not be found.
Sorry, we couldn't find the page you were looking for. It may have been moved or deleted.
The page you requested does not exist. Check the spelling of the address or go to the home page.
Oops! Something went wrong. Please try again later.
Whoops, looks like something went wrong.
An unexpected error has occurred. Please contact the site administrator.
We're sorry, but something went wrong. If you are the application owner check the logs for more information.
502 Bad Gateway nginx/1.18.0
504 Gateway Time-out. The server didn't respond in time.
500 Internal Server Error. The server encountered an internal error and was unable to complete your request.
Web server is down. Error code 521.
Your connection is not private. Attackers might be trying to steal your information. NET::ERR_CERT_DATE_INVALID
Hmm. We're having trouble finding that site. We can't connect to the server.
DNS_PROBE_FINISHED_NXDOMAIN. Check if there is a typo in the address.
Access Denied. You don't have permission to access this page on this server. Reference #18.2d3a
Sorry, you have been blocked. You are unable to access this website. Please enable cookies.
Checking your browser before accessing the site. This process is automatic. Please allow up to 5 seconds.
Please verify you are a human. Access to this page has been denied because we believe you are using automation tools.
Our systems have detected unusual traffic from your computer network. Please try your request again later.
Please complete the security check to access the site.
Too Many Requests. You have exceeded the rate limit. Please wait and try again.
API rate limit exceeded. Please retry after 60 seconds.
You have reached your article limit. Subscribe to continue reading.
This content is for subscribers only. Please log in or subscribe to read the full article.
Please log in to view this page.
You must be logged in to access this content.
Your session has expired. Please log in again to continue.
Session timed out due to inactivity. Please sign in again.
This content is not available in your country.
Sorry, this video is not available in your region.
The website is under maintenance. We will be back soon.
We are currently performing scheduled maintenance. Please check back later.
Site is undergoing maintenance. Thank you for your patience.
Fatal error: Uncaught Error: Call to undefined function get_header() in /var/www/html/index.php on line 17
Warning: mysqli_connect(): Connection refused in /var/www/html/db.php on line 8
Parse error: syntax error, unexpected end of file in /home/site/index.php on line 214
Traceback (most recent call last): File "/app/views.py", line 88, in get TypeError: unsupported operand type
Exception in thread "main" java.lang.NullPointerException at com.example.Main.main(Main.java:12)
ProgrammingError: relation "accounts" does not exist
The connection has timed out. The server at www.example.com is taking too long to respond.
ERR_CONNECTION_REFUSED. The site refused to connect.
The request could not be satisfied. Request blocked. We can't connect to the server for this app or website at this time.
This account has been suspended. Contact your hosting provider for more information.
The document has been removed or is no longer available.
File not found. The file may have been moved, renamed or deleted.
{"error": {"code": 401, "message": "Unauthorized: authentication token is missing or invalid"}}
{"message": "Not Found", "status": 404}
HTTP Error 403 - Forbidden: Access is denied.
Failed to load resource: the server responded with a status of 500 (Internal Server Error)
Your request could not be processed. Please try again or contact support.
Unable to load the page. Check your internet connection and reload.
The content could not be displayed because of a technical problem.
You must have JavaScript activated to use this site.
JavaScript is required to view this page.
JavaScript is disabled in your browser. Please enable it to continue.
This site requires JavaScript. Please enable JavaScript in your browser settings and reload the page.
For full functionality of this site it is necessary to enable JavaScript. Here are the instructions how to enable JavaScript in your web browser.
We're sorry but this app doesn't work properly without JavaScript enabled. Please enable it to continue.
Your browser does not support JavaScript or it is turned off.
To use this page you need a browser that supports JavaScript.
Please turn on JavaScript and cookies in your browser to proceed.
Your browser is not supported. Please upgrade to a newer version.
We have detected that you are using an ad blocker. Please disable your ad blocker to read this article.
Enable JavaScript and cookies to continue
Die angeforderte Seite konnte leider nicht gefunden werden.
Fehler 404: Die Seite existiert nicht oder wurde verschoben.
Diese Website ist nicht erreichbar. Prüfen Sie Ihre Internetverbindung.
Es ist ein unerwarteter Fehler aufgetreten. Bitte versuchen Sie es später erneut.
Zugriff verweigert. Sie haben keine Berechtigung, diese Seite anzuzeigen.
Ihre Sitzung ist abgelaufen. Bitte melden Sie sich erneut an.
Wegen Wartungsarbeiten ist unser Dienst vorübergehend nicht erreichbar.
Bitte aktivieren Sie JavaScript in Ihrem Browser, um diese Seite zu nutzen.
Dieser Artikel ist nur für Abonnenten verfügbar. Bitte melden Sie sich an.
Der Server konnte Ihre Anfrage nicht verarbeiten. Interner Serverfehler.
Bitte bestätigen Sie, dass Sie kein Roboter sind.
La page que vous recherchez est introuvable.
Erreur 500 : une erreur interne du serveur s'est produite.
Désolé, cette page n'existe pas ou a été déplacée.
Accès refusé. Vous n'avez pas l'autorisation d'accéder à cette page.
Le site est actuellement en maintenance. Merci de réessayer plus tard.
Votre session a expiré, veuillez vous reconnecter.
Veuillez activer JavaScript dans votre navigateur pour continuer.
Une erreur inattendue est survenue. Veuillez réessayer ultérieurement.
Cet article est réservé aux abonnés. Connectez-vous pour lire la suite.
Impossible de se connecter au serveur. Vérifiez votre connexion internet.
La página que busca no existe o ha sido eliminada.
Lo sentimos, no hemos podido encontrar la página solicitada.
Error 403: acceso denegado. No tiene permiso para ver esta página.
Se ha producido un error inesperado. Inténtelo de nuevo más tarde.
Su sesión ha expirado. Inicie sesión de nuevo.
El sitio está en mantenimiento. Vuelva más tarde.
Por favor, habilite JavaScript en su navegador para ver este sitio.
Este contenido es solo para suscriptores. Inicie sesión para continuar.
No se puede acceder a este sitio web. Compruebe su conexión a internet.
La pagina richiesta non è stata trovata.
Si è verificato un errore. Riprova più tardi.
Accesso negato: non hai i permessi per visualizzare questa pagina.
Per visualizzare questo sito è necessario abilitare JavaScript nel browser.
Il sito è in manutenzione. Torna più tardi.
Página não encontrada. O endereço pode estar incorreto.
Ocorreu um erro inesperado. Por favor, tente novamente mais tarde.
Acesso negado. Não tem permissão para ver esta página.
Ative o JavaScript no seu navegador para continuar.
De pagina die u zoekt kan niet worden gevonden.
Er is een fout opgetreden. Probeer het later opnieuw.
Toegang geweigerd. U heeft geen toestemming om deze pagina te bekijken.
Schakel JavaScript in om deze website te gebruiken.
"""

FILLERS = """
Lorem ipsum dolor sit amet, consectetur adipiscing elit, sed do eiusmod tempor incididunt ut labore et dolore magna aliqua.
Ut enim ad minim veniam, quis nostrud exercitation ullamco laboris nisi ut aliquip ex ea commodo consequat.
Sed ut perspiciatis unde omnis iste natus error sit voluptatem accusantium doloremque laudantium.
Nemo enim ipsam voluptatem quia voluptas sit aspernatur aut odit aut fugit.
Curabitur pretium tincidunt lacus. Nulla gravida orci a odio.
Pellentesque habitant morbi tristique senectus et netus et malesuada fames ac turpis egestas.
This is a sample page.
This is dummy text.
Placeholder text. Replace with your own content before publishing.
Insert your text here.
Your headline goes here
Add your description here.
Type your text here.
Sample paragraph text goes here.
Click edit button to change this text.
I am text block. Click edit button to change this text. Lorem ipsum dolor sit amet, consectetur adipiscing elit.
Content coming soon.
Coming soon
Test test test
asdf asdf asdf
This is a placeholder paragraph.
Replace this text with a short summary.
Write a short introduction here.
Hier steht Ihr Text.
Dies ist ein Blindtext.
Mustertext, bitte ersetzen.
Platzhaltertext ohne Inhalt.
Inhalt folgt.
Ceci est un texte d'exemple.
Votre texte ici.
Saisissez votre texte ici.
Contenu à venir.
Este es un texto de ejemplo.
Escriba aquí su texto.
Inserte su texto aquí.
Próximamente.
Questo è un testo di esempio.
Inserisci qui il tuo testo.
Insira o seu texto aqui.
Voorbeeldtekst. Plaats hier uw tekst.
"""

SLOTS = """
Dear {{first_name}}, your order has been shipped and will arrive on Tuesday.
Dear [Customer Name], thank you for contacting our support team.
Hello {name}, we are pleased to confirm your booking for two nights.
Hi ${user.name}, your invoice for March is attached.
Dear null, your subscription renews next week.
Hello undefined, welcome back to the reading club.
Sehr geehrte Frau {{nachname}}, vielen Dank für Ihre Bestellung.
Bonjour [PRÉNOM], votre commande a été expédiée hier.
Estimado {{nombre}}, su pedido llegará mañana por la tarde.
The total of your order is $undefined and will be charged today.
Shares of {{company}} rose sharply after the opening bell.
Revenue grew by {percent} in the third quarter, the company said.
The meeting will take place on [DATE] in the main hall.
Please send the signed form to [insert address here] before Friday.
The contract between [COMPANY NAME] and the city runs for ten years.
Our guest tonight is %GUEST_NAME%, who wrote the book.
The temperature reached NaN degrees in the early afternoon, and the beach was full.
The ship left port with None passengers on board.
Sales rose from null to null over the summer.
Our analyst expects a profit of __AMOUNT__ for the year.
The winner is <winner_name> from the northern district.
Prices start at {{ price | currency }} for a single room.
Welcome to <%= city %>, the gateway to the lakes.
The museum opens at ${opening_time} on weekdays.
Her new album, [ALBUM TITLE], comes out in May.
The train leaves from platform {0} at {1} every morning.
We apologise for the delay of undefined minutes.
The court fined the firm #REF! for the breach.
Tickets cost XX.XX and are sold at the door.
The tenant pays ____ per month for the flat on the second floor.
Der Zug fährt um {{abfahrt}} von Gleis 4 ab.
Die Stadt hat [EINWOHNERZAHL EINTRAGEN] Einwohner.
El precio sube a {precio} desde el lunes.
Le maire de [VILLE] a inauguré le pont samedi.
La partita inizia alle {{orario}} di domenica.
O preço do bilhete é de {{preco}} por pessoa.
De trein vertrekt om {{tijd}} van spoor vier.
Contact [Your Name] for further information about the programme.
According to @@SOURCE@@ the bridge will close for a month.
The award went to [[winner]] for a study of coral reefs.
"""

HARD = """
The court declared the merger agreement null and void on Tuesday.
The scope of the new tariff remains undefined, officials said on Friday.
Rejecting the null hypothesis, the authors find a drift after earnings.
[BREAKING NEWS] Shares of the bank rose ten percent before noon.
[APPLAUSE] Thank you, operator, and good morning everyone.
We expect [inaudible] to grow next year, said the chief executive.
A List<T> holds items of one type, and Map<String, Integer> counts them.
{"id": 7, "name": "Ann", "price": null, "tags": []}
Name: ______ Date: ______ Signature: ______
The function returns None if the key is missing and the value otherwise.
In JavaScript, null and undefined are two different values.
NaN is not equal to itself, as the standard says.
To rename a file, type mv <old> <new> and press enter.
The template engine replaces {{name}} with the value of the field.
Use {0} and {1} in the format string; the library fills them in order.
In the config, set path=${HOME}/data and restart the daemon.
The header contains <title> and <meta> tags, followed by the body.
Set price to null when the quote is missing.
The array [NAME, DATE] is passed to the macro.
None of the three candidates won a majority in the first round.
The match ended nil-nil after extra time.
The team won two nil away from home.
The speed limit in the village was changed from 50 to 30.
A 404 error is shown when a page is not found, and search engines then drop the page from their index.
The outage began at noon, when users saw a 503 page, the operator said in a statement.
Users complained that the site was not available for three hours on election night.
The access panel was removed by the crew, and the engineers found a broken valve behind it.
The senator was denied access to the records, her lawyer said.
He was not authorized to sign the contract, the judge found.
The company disabled JavaScript on its old portal after researchers found a flaw.
JavaScript was created in ten days in 1995 and is now used on most websites.
The robot that cleans the station was blocked by a suitcase for an hour.
Lorem ipsum is a filler text that printers have used since the sixteenth century, according to a popular account.
The designer put placeholder text in the brochure and forgot to replace it, which cost the agency a client.
The film is coming soon to cinemas across the country, the distributor said, with previews in ten cities next month.
The judge ruled that the sample text in the contract wasn't binding on the tenant.
The town has been under maintenance of the regional council since the flood, and the bridge is to reopen in June.
The treaty does not exist in a final form yet, diplomats said on Thursday.
The missing hiker could not be found despite a search with dogs and drones.
The ministry said the document had been removed from the archive by mistake in 1974.
Please enable two-factor login before the audit in May, the memo to staff says, and hand in the old badges at the front desk.
See note [4] and the appendix [B] for the method.
"It [the bank] will repay the loan," she said.
The set {1, 2, 3} has eight subsets.
Let f(x) = {x} denote the fractional part of x.
If a < b and c > d then the interval is empty.
The index fell 3% to 4,120 points, while $AAPL and $MSFT rose.
The film won 5 awards [sic] and 2 nominations.
SELECT name FROM users WHERE deleted_at IS NULL ORDER BY name;
def greet(name): return f"Hello {name}, welcome"
const label = `Hello ${user}`; console.log(label);
print("%(name)s is %(age)d years old" % person)
for (int i = 0; i < n; i++) { sum += a[i]; }
The form has four fields: name, date, address and signature.
Write your name in the first box and the date in the second box of the form.
The pattern YYYY-MM-DD is used for all dates in the report.
Die Inflation lag im Mai bei null Prozent, teilte das Amt mit.
Der Vertrag ist null und nichtig, entschied das Gericht.
Die Temperatur fiel auf null Grad, und auf den Brücken bildete sich Eis.
Die Seite des Anbieters war am Montag drei Stunden lang nicht erreichbar, sagte ein Sprecher.
Der Zugang zum Archiv wurde den Forschern verweigert, wie die Zeitung berichtete.
Le contrat est nul et non avenu, a jugé le tribunal.
Le document n'existe pas dans les archives, a déclaré la ministre.
La carta no existe, dijo el portavoz, y el archivo fue revisado dos veces.
El acceso a la playa fue cerrado por el ayuntamiento hasta septiembre.
Il contratto non esiste più, ha detto il ministro, e la causa è chiusa.
A ponte foi removida em 1990, disse o presidente da câmara.
De brug is verwijderd en komt in het voorjaar terug, zei de wethouder.
Habeas corpus is an old remedy, and pro bono work is common in the firm.
The motto "citius, altius, fortius" was adopted in 1894.
Fans chanted "veni, vidi, vici" after the final.
Rosa, Maria, Clara and Lucia met in Roma in May.
The error in the ledger was found by an auditor, who corrected the entry.
Traffic was unusual for a Sunday: eleven thousand cars crossed the bridge.
Our engineers have found the fault in the pump and will replace it in two weeks.
The request for a permit was denied because the plans lacked a fire exit.
The connection between the two villages has been refused by the county on cost grounds.
The bakery is temporarily closed and will be back in August with a new oven, the owner told the paper.
In the trial, 40 patients were not available for follow-up after six months.
The parser raised KeyError because the currency column was missing, and the fix was shipped the same day.
A timeout of 30 seconds is too short for the nightly export, so the team raised it to 120.
Robots.txt tells crawlers which pages of a site they may visit.
Cookies are baked at 180 degrees for twelve minutes.
The session of parliament has been moved to Tuesday, and the vote will be held on Thursday.
The library now lends e-books; members log in with the number on their card.
The browser maker said its market share had reached ten percent in Europe.
Try again, fail again, fail better, wrote Beckett.
The server brought the wrong dish, but the kitchen replaced it without a word.
A script for the new play has been found in the author's house.
Permission to build forty flats was granted after a long debate in the council.
The page was torn from the manuscript in the nineteenth century and sold in Paris.
Maintenance of the dam will cost 12 million euros a year, the study says.
The null result was published after two years of review.
Undefined behaviour in C lets the compiler assume that it never happens.
The variable is undefined until the script has run once.
Hyphens like this one ---- separate the sections of the old ledger.
The grammar rule reads <expr> ::= <term> | <expr> "+" <term>.
Version %VERSION% is replaced by the build script with the number of the release.
"""

NEUTRAL = """
The harbour authority opened a second berth on Monday and expects forty more ships a month.
Margins widened as freight costs fell, while demand from the building trade stayed flat.
The orchestra will tour six cities in the autumn under its new conductor.
Rain is expected in the north, with dry spells along the coast towards the weekend.
The village school has two new teachers and a garden that the pupils tend themselves.
Die Brücke über den Fluss wird im Sommer für vier Wochen gesperrt, weil der Belag erneuert wird.
Le marché du samedi accueille désormais une vingtaine de producteurs de la vallée.
La cosecha de aceituna será menor este año por la falta de lluvia en primavera.
"""


def lines(text):
    return [x for x in text.strip().splitlines() if x]


def residue_texts():
    """(text, kind): each message alone and, behind navigation or with an opening line; each filler and slot alone and within an article."""
    out = []
    neutral = lines(NEUTRAL)
    for i, t in enumerate(lines(ERRORS)):
        out += [(t, "error"), (f"Home | News | Sport | Contact\n\n{t}" if i % 2 else f"{neutral[i % 8].split('.')[0]}\n{t}", "error")]
    for i, t in enumerate(lines(FILLERS)):
        out += [(t, "filler"), (f"{neutral[i % 8]}\n\n{t}", "filler")]
    for i, t in enumerate(lines(SLOTS)):
        out += [(t, "slot"), (f"{neutral[i % 8]} {neutral[(i + 3) % 8]}\n\n{t}", "slot")]
    return out


def ordinary_texts():
    """Each hard text alone and in four surroundings, and all pairs of neutral sentences."""
    neutral = lines(NEUTRAL)
    out = []
    for i, t in enumerate(lines(HARD)):
        a, b = neutral[i % 8], neutral[(i + 5) % 8]
        out += [t, f"{a} {t}", f"{t}\n\n{b}", f"{a}\n\n{t}\n\n{b}", f"{a} {b} {t}"]
    return out + [f"{x} {y}" for x in neutral for y in neutral if x != y]


#: Written after the rules had been corrected by what the texts above showed, and measured once.
SECOND_RESIDUE = """
The resource you are looking for has been removed, had its name changed, or is temporarily unavailable.
We can't seem to find the page you're looking for. Here are some helpful links instead.
Sorry, this page isn't available. The link you followed may be broken, or the page may have been removed.
This page isn't working. example.com redirected you too many times.
No results were returned because the database server is not responding.
You are not authorized to view this page. Please contact the administrator for access.
Invalid credentials. Your login session could not be verified.
Please wait while your request is being verified...
One more step. Please complete the captcha to continue.
We use cookies and scripts. Enable them in your browser settings, then refresh.
Looks like you have JavaScript switched off. Switch it on to see this page.
<noscript>You need to enable JavaScript to run this app.</noscript>
The application failed to start because of a configuration error. See the log file for details.
Error 1020. Access denied. This website is using a security service to protect itself from online attacks.
HTTP Status 404 – Not Found. The origin server did not find a current representation for the target resource.
Object moved. This document may be found here.
Upstream connect error or disconnect/reset before headers. Reset reason: connection failure.
Maximum execution time of 30 seconds exceeded in /srv/www/app/lib/cache.php on line 210.
Diese Seite kann nicht angezeigt werden. Bitte wenden Sie sich an den Administrator.
Der Artikel ist leider nicht mehr verfügbar.
Zu viele Anfragen. Bitte warten Sie einen Moment und laden Sie die Seite neu.
Oups ! La page demandée n'a pas été trouvée.
Ce contenu n'est pas disponible dans votre pays.
Trop de requêtes. Merci de patienter quelques instants avant de réessayer.
¡Ups! Algo salió mal. Vuelva a intentarlo en unos minutos.
El contenido que busca ya no está disponible.
Contenuto non disponibile nel tuo paese.
Este conteúdo não está disponível na sua região.
Deze pagina bestaat niet meer. Ga terug naar de startpagina.
Quis autem vel eum iure reprehenderit qui in ea voluptate velit esse quam nihil molestiae.
Add a headline that sums up the story.
Your company slogan here
Hier können Sie Ihren eigenen Text einfügen.
Dear {{ contact.first_name | default: "friend" }}, the tickets are on sale.
The parcel weighs null kilograms and left the depot yesterday.
Rent for the shop is [AMOUNT] a month, plus heating.
Good morning %NAME%, your table is booked for eight.
The river rose by undefined metres overnight, flooding the lower town.
Please reply to [your email address] by Monday.
Our next issue appears on {{publication_date}} with a report on bees.
"""

SECOND_ORDINARY = """
The museum said that a page of the codex could not be found and that the police had been told.
A bad gateway to the harbour cost the port a decade of growth, the historian writes.
Researchers were unable to complete the survey because the glacier had moved.
Access to clean water is still not available to a tenth of the region, the report says.
The airline said something went wrong with the fuel gauge and apologised to the passengers.
Our correspondent was blocked from entering the hall and reported from the car park instead.
The bank has enabled scripts on its branches' screens that read text aloud for blind clients.
The council will try again in May to find a buyer for the old mill.
The app needs location data to work, which privacy groups have criticised for years.
Engineers found an internal error in the turbine controller and shut the plant for two days.
The word placeholder comes from mathematics, where it marks an empty position in a formula.
Add the flour, then write down the weight, and insert the dough into the tin.
The sample showed traces of lead; the text of the report gives no amounts.
Coming soon to the old bakery on Mill Lane: a cinema with forty seats, run by volunteers.
A test of the sirens is held on the first Monday of each month at noon.
The verdict was null and void, and the clerk struck it from the roll.
In Python, use x is None to test for a missing value.
The type Result<T, E> carries either a value or an error.
Run cp <source> <target> and then check the size of both files.
The macro %TEMP% points to a folder that is emptied at night.
His memoir, Undefined, was published in the spring and sold well.
None but the brave deserves the fair, wrote Dryden.
The lake has nil oxygen below ten metres, the biologists report.
[Laughter] Next question, please.
The speaker said "[our] rivals have no plan" and sat down.
{"event": "trade", "qty": null, "note": "late"}
Signature: ____________________
Tel. ______________ Fax ______________
Use {{#each items}} to loop over a list in the template language.
The regex [A-Z]{3} matches three capital letters.
Der Stürmer traf zum null zu eins kurz vor der Pause.
Bei null Wachstum sinken die Steuereinnahmen, warnte der Minister.
Die gesuchte Adresse lag am Ende einer Gasse hinter dem Markt.
L'accès au port reste interdit aux camions jusqu'à la fin des travaux, selon la mairie.
La sesión del parlamento terminó tarde y el presidente pidió disculpas.
La página más famosa del manuscrito se expone en Madrid hasta junio.
A sessão foi suspensa depois de um erro na contagem dos votos.
De toegang tot het strand is weer vrij nadat het hek was verwijderd.
Password rules changed in June: staff now sign in with a card and a code of six digits.
Servers at the restaurant went on strike on Friday and asked for a ten percent rise.
The mountain road is closed for maintenance until April; drivers should use the valley road.
The gallery removed the picture after the loan expired, and the wall is empty now.
Errors in the tide table led two yachts onto the sandbank at dusk.
The ministry has denied that the files were deleted.
Traffic to the shop's website doubled after the broadcast, and orders rose by half.
The script was read by the whole cast before the director enabled the lights.
She asked for the address of the page boy who had moved to Lyon.
The old browser of the deer herd was found near the stream.
A request line for songs is open from six to eight each evening.
The novel's last page is missing, so the ending remains a matter of debate.
"""
