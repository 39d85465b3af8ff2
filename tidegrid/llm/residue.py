"""Template residue and error-page text: detect records that hold no real content.

Method: phrases of failed pages, access and script notices and filler in seven
languages, and the signs with which placeholders begin, are one multi-pattern
automaton (Aho-Corasick), which reads each whole text once. What it finds decides
by coverage:

* error pages: a text with such a phrase is one if phrases and the vocabulary of
  such pages cover most of its content letters; navigation, markup, identifiers
  and function words aside, and also without its opening line.
* filler: the same within one sentence, with the vocabulary of layouts, as filler
  counts in parts of a text too; or a sentence without any function word whose
  words look like filler Latin.
* placeholders: at each sign, a value that was never filled in must have its full
  syntax and stand in value position, in a sentence that neither writes about
  templates nor is code, a format or a form. Words for an empty value (null,
  undefined, NaN, None, nil) need a greeting, a currency, a unit, or a
  preposition before and no further noun behind.

Each text is judged on its own in Arrow batches: no shuffle, no state, no skew.
The phrases are general messages of servers, browsers, frameworks and layout
tools; none was collected from the test documents.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from functools import lru_cache
from http import HTTPStatus

import ahocorasick
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType, StructField, StructType

#: Share of the content letters that phrases and vocabulary must cover.
ERROR_COVERAGE = 0.6
FILLER_COVERAGE = 0.6
#: Coverage by vocabulary that needs no phrase, and the words it takes.
VOCABULARY_ALONE, VOCABULARY_WORDS = 0.85, 3
#: Letters that error phrases must hold, as a share of all letters, for a text to be measured at all.
LEAST_PHRASES = 0.04
LATIN_WORDS, LATIN_SHARE = 4, 0.7

# --- fixed values: phrases by language ---------------------------------------------------------------------------

ERROR_PHRASES = {
    "en": """
        page not found|not found|could not be found|couldn't be found|can't be found|cannot be found|can't find|cannot find|could not find|couldn't find|were unable to find|unable to find|seem to find|isn't working|is not working|redirected you|object moved|be verified|being verified|failed to start|execution time|connect error|connection failure
        does not exist|doesn't exist|no longer exists|no longer available|not available|isn't available|currently unavailable|temporarily unavailable|service unavailable|is unavailable|been removed|been deleted|been moved|has moved|has expired|may have moved
        bad request|bad gateway|gateway timeout|gateway time-out|internal server error|internal error|server error|not implemented|method not allowed|too many requests|too many redirects|request entity too large|payload too large|unsupported media type|precondition failed|http error|error code
        access denied|access is denied|permission denied|access forbidden|forbidden|unauthorized|unauthorised|not authorized|not authorised|not allowed|don't have permission|do not have permission|no permission|been blocked|is blocked|been denied|is denied|authentication required|authorization required|login required
        timed out|took too long|can't be reached|cannot be reached|could not be reached|can't reach|unable to connect|could not connect|can't connect|failed to connect|refused to connect|connection refused|connection was reset|connection reset|connection closed|connection failed|lost connection|no internet|dns_probe|err_connection|err_name|server is down|server not responding|not responding|host not found|name not resolved
        failed to load|could not be loaded|couldn't be loaded|could not load|couldn't load|unable to load|could not be displayed|cannot be displayed|can't be displayed|cannot be shown|can't be shown|could not be rendered|could not be opened|could not be processed|could not be completed|unable to complete|unable to process|unable to display|failed to fetch|request failed|query failed|loading failed
        session has expired|session expired|session timed out|logged out|log in first|please log in|please login|please sign in|sign in again|log in again|sign in to continue|log in to continue|must be logged in|must be signed in|only open to members|only available to subscribers|only available to members|for subscribers only|members only|subscribe to continue|subscribe to read|to continue reading
        went wrong|error occurred|error has occurred|unexpected error|unknown error|fatal error|application error|runtime error|critical error|parse error|syntax error|database error|database connection|unhandled exception|uncaught exception|exception occurred|exception in thread|stack trace|traceback (most recent call last)|segmentation fault|out of memory|try again later|please try again|try again in|retry after|refresh to retry|something broke|encountered an error|encountered a problem|experiencing technical|"error":|'error':|"status": "error"|error:|exception:
        under maintenance|down for maintenance|scheduled maintenance|undergoing maintenance|maintenance mode|be back soon|be back shortly|back online|over capacity|rate limit|quota exceeded|limit exceeded|limit reached|bandwidth limit|request limit
        not a robot|are human|you are a human|you're human|unusual traffic|unusual activity|suspicious activity|automated queries|automated requests|checking your browser|security check|complete the captcha|solve the captcha|ddos protection|verifying you|verify you|connection is not private|connection is not secure|been suspended|err_cert|err_ssl|err_timed
        in your region|in your country|from your location
        enable javascript|javascript enabled|javascript is disabled|javascript disabled|javascript is turned off|javascript turned off|javascript is switched off|javascript switched off|javascript is not enabled|javascript is required|javascript required|requires javascript|require javascript|needs javascript|need javascript|without javascript|javascript activated|activate javascript|javascript turned on|turn on javascript|allow javascript|support javascript|javascript to run|javascript to be enabled|javascript must be|javascript to view|supports javascript|browser supports|device supports|nothing appears|nothing loads
        enable scripts|scripts enabled|scripts are disabled|scripts are blocked|scripts disabled|allow scripts|enable scripting|scripting is disabled|scripts are turned off|scripts to run|js enabled|enable js|js to run|js is turned off|js must be|js is disabled|allow js|without js|js to view|requires js|needs js|scripts must be|scripting must be|scripts is turned off|scripting is turned off|scripts enabled|scripting enabled|scripting to run|allow scripting|enable cookies|cookies enabled|cookies are disabled|cookies must be|cookies are blocked|allow cookies|cookies is turned off|cookies to run|disable your ad blocker|turn off your ad blocker|disable any blocker|ad blocker detected|browser is not supported|unsupported browser|browser not supported|update your browser|upgrade your browser|outdated browser""",
    "de": """
        nicht gefunden|nicht mehr verfügbar|nicht verfügbar|nicht erreichbar|existiert nicht|nicht vorhanden|nicht geladen werden|nicht angezeigt werden|nicht geöffnet werden|nicht bearbeitet werden|nicht verarbeitet werden|nicht hergestellt werden|wurde entfernt|wurde gelöscht|wurde verschoben
        zugriff verweigert|zugang verweigert|keine berechtigung|nicht berechtigt|nicht autorisiert|zugriff nicht gestattet|wurde blockiert|wurde gesperrt|ist gesperrt|interner serverfehler|serverfehler|fehlerhafte anfrage|ungültige anfrage|zu viele anfragen|zeitüberschreitung
        fehler aufgetreten|fehler ist aufgetreten|unerwarteter fehler|etwas schiefgelaufen|etwas schief gelaufen|ist schiefgelaufen|ging schief|sitzung ist abgelaufen|sitzung abgelaufen|erneut anmelden|melden sie sich|bitte anmelden|nur nach anmeldung|anmeldung erforderlich|nur für abonnenten|nur für mitglieder|später erneut|später noch einmal|später wieder|noch einmal versuchen|versuchen sie es
        wartungsarbeiten|wird gewartet|im wartungsmodus|kein roboter|ungewöhnlicher datenverkehr|ungewöhnliche aktivität|in ihrem land|in ihrer region
        javascript aktivieren|aktivieren sie javascript|javascript ist deaktiviert|javascript deaktiviert|javascript ist ausgeschaltet|benötigt javascript|erfordert javascript|javascript erforderlich|ohne javascript|javascript einschalten|skripte ausgeschaltet|skripte deaktiviert|skripte sind|aktivieren sie cookies|cookies aktivieren|cookies akzeptieren|browser wird nicht unterstützt""",
    "fr": """
        page introuvable|introuvable|n'existe pas|n'existe plus|n'est plus disponible|n'est pas disponible|pas disponible|indisponible|inaccessible|a été supprimée|a été supprimé|a été déplacée|n'a pas été trouvée|n'a pas été trouvé|pas pu être chargée|pas pu être chargé|pas pu être affichée|pas pu être affiché|ne peut pas être affichée|ne peut pas être affiché|n'a pas pu aboutir|n'a pas pu être|pas pu trouver|impossible de se connecter|impossible d'afficher|impossible de charger|impossible d'accéder|impossible de trouver
        accès refusé|accès interdit|accès non autorisé|non autorisé|pas autorisé|pas l'autorisation|autorisation requise|a été bloqué|est bloqué|erreur interne|erreur serveur|erreur du serveur|requête incorrecte|mauvaise requête|trop de requêtes|délai d'attente|délai dépassé
        erreur est survenue|erreur s'est produite|erreur inattendue|quelque chose s'est mal passé|un problème est survenu|session a expiré|session expirée|veuillez vous reconnecter|veuillez vous connecter|reconnectez-vous|connectez-vous|réservée aux abonnés|réservé aux abonnés|réservé aux membres|réessayez plus tard|veuillez réessayer|réessayer plus tard|réessayez
        en maintenance|cause de maintenance|maintenance en cours|pas un robot|trafic inhabituel|activité inhabituelle|dans votre pays|dans votre région
        activer javascript|activez javascript|javascript est désactivé|javascript désactivé|besoin de javascript|nécessite javascript|requiert javascript|sans javascript|scripts sont désactivés|activer les scripts|activez les scripts|activer les cookies|activez les cookies|navigateur n'est pas pris en charge""",
    "es": """
        página no encontrada|no encontrada|no encontrado|no se encuentra|no se ha encontrado|no se encontró|no existe|ya no existe|no está disponible|no disponible|ya no está|ha sido eliminada|ha sido eliminado|ha sido movida|no se ha podido cargar|no se pudo cargar|no se puede mostrar|no se pudo mostrar|no se pudo completar|no se pudo procesar|no se puede acceder|no se puede conectar|no podemos encontrar|podido encontrar|pudimos encontrar|podido cargar|podido completar
        acceso denegado|acceso prohibido|acceso restringido|no autorizado|no está autorizado|no tiene permiso|sin permiso|ha sido bloqueado|está bloqueado|error interno|error del servidor|solicitud incorrecta|demasiadas solicitudes|demasiadas peticiones|tiempo de espera
        se ha producido un error|ha ocurrido un error|ocurrió un error|error inesperado|algo salió mal|algo ha ido mal|ha habido un problema|sesión ha caducado|sesión ha expirado|sesión caducada|inicie sesión|iniciar sesión|inicia sesión|solo para suscriptores|a suscriptores|solo para socios|inténtelo más tarde|inténtelo de nuevo|inténtalo de nuevo|intente más tarde|más tarde
        en mantenimiento|tareas de mantenimiento|por mantenimiento|no es un robot|no eres un robot|tráfico inusual|actividad inusual|en su país|en su región
        active javascript|activar javascript|habilite javascript|habilitar javascript|javascript está desactivado|javascript desactivado|javascript deshabilitado|necesita javascript|requiere javascript|sin javascript|scripts están desactivados|active los scripts|habilite los scripts|active las cookies|habilite las cookies|navegador no es compatible""",
    "it": """
        pagina non trovata|non trovata|non trovato|stata trovata|stato trovato|non esiste|non è disponibile|non è più disponibile|non disponibile|non raggiungibile|è stata rimossa|è stato rimosso|impossibile caricare|impossibile trovare|impossibile visualizzare|impossibile raggiungere|impossibile stabilire|accesso negato|accesso vietato|non autorizzato|non hai i permessi|non dispone dell'autorizzazione|errore interno|errore del server|richiesta non valida|troppe richieste|tempo scaduto
        si è verificato un errore|errore imprevisto|qualcosa è andato storto|sessione scaduta|sessione è scaduta|effettua l'accesso|effettuare l'accesso|accedi di nuovo|solo per abbonati|riservato agli abbonati|riprova più tardi|riprovare più tardi|in manutenzione|non sei un robot|traffico insolito|nel tuo paese
        abilita javascript|abilitare javascript|attiva javascript|attivare javascript|javascript è disattivato|javascript disabilitato|richiede javascript|abilita i cookie|abilitare i cookie|browser non è supportato""",
    "pt": """
        página não encontrada|não encontrada|não encontrado|não foi encontrada|não foi encontrado|não existe|não está disponível|não está mais disponível|indisponível|foi removida|foi removido|não foi possível|acesso negado|acesso proibido|não autorizado|não tem permissão|erro interno|erro do servidor|pedido inválido|solicitação inválida|muitas solicitações|tempo limite
        ocorreu um erro|erro inesperado|algo deu errado|algo correu mal|sessão expirou|sessão expirada|faça login|inicie sessão|apenas para assinantes|exclusivo para assinantes|tente novamente|tente mais tarde|em manutenção|não é um robô|tráfego incomum|no seu país
        ative o javascript|ativar o javascript|habilite o javascript|habilitar javascript|javascript está desativado|javascript desativado|requer javascript|ative os cookies|habilite os cookies|navegador não é compatível""",
    "nl": """
        pagina niet gevonden|niet gevonden|bestaat niet|niet beschikbaar|niet meer beschikbaar|niet bereikbaar|is verwijderd|kan niet worden weergegeven|niet worden gevonden|niet vinden|kan niet worden geladen|toegang geweigerd|geen toegang|geen toestemming|niet gemachtigd|interne serverfout|serverfout|ongeldig verzoek|te veel verzoeken
        fout opgetreden|onverwachte fout|iets misgegaan|ging iets mis|sessie is verlopen|sessie verlopen|log opnieuw in|alleen voor abonnees|probeer het later|probeer het opnieuw|in onderhoud|onderhoudswerkzaamheden|geen robot|ongewoon verkeer|in uw land
        schakel javascript in|javascript inschakelen|javascript is uitgeschakeld|javascript uitgeschakeld|vereist javascript|javascript nodig|schakel cookies in|cookies inschakelen|browser wordt niet ondersteund""",
}

#: Vocabulary of such pages: covers letters, but is no sign of one by itself.
ERROR_WORDS = {
    "en": """
        page pages site website web webpage url link links address browser browsers server servers service services request requests requested resource document documents article story note post content contents file files image video text data database query relation table record object host hosts proxy gateway network internet domain port certificate
        error errors fault exception failure failed fails fail problem problems issue issues trouble technical difficulties code status http https html message messages details information info description warning notice reference id request-id ray incident ip trace node backend upstream origin cache apache nginx iis tomcat ubuntu cloudflare varnish character characters line column module function file
        please sorry oops whoops uh-oh unfortunately apologize apologies apologise inconvenience try trying tried again later soon shortly moment moments minute minutes second seconds hour hours refresh reload retry wait waiting check checked checking verify verifying confirm ensure make sure click press use used using visit visiting visited return back go going home homepage start main front previous search searching box menu button below above following
        log login logged sign signed account password username credentials session expired access accessed accessing permission permissions permitted allow allowed allows deny denied block blocked blocks blocker policy rights authorized credentials view viewing viewed display displayed displaying show shown load loaded loading read reading open opened opening render rendered fetch process processed processing complete completed completing perform
        enable enabled enabling disable disabled turn turned turning switch switched activate activated on off javascript js script scripts scripting cookies cookie adblock ad-blocker ad plugin extension extensions settings options setting required requires require need needs needed run runs running app application feature features work works working function functions properly correctly support supports supported version upgrade update older newer modern different another device
        contact contacting support help desk helpdesk administrator administrators admin webmaster owner owners team engineers staff customer operator provider notified informed told know aware fix fixing resolve resolved quote time
        maintenance temporarily currently unavailable available availability down offline online busy overloaded capacity high load traffic unusual exist exists existed never moved removed deleted renamed found find looking look missing broken mistyped typed type entered enter typing spelling spelled correct incorrect wrong invalid expired outdated dead old changed
        region country location area territory members member subscribers subscriber subscription subscribe premium register registered free robot robots bot human captcha security secure protection protected firewall limit limits exceeded reached rate calls many maximum per hour timeout timed long respond responded responding response answer answers reply connect connected connecting connection connections establish establishing establish unreachable reachable unknown unexpected internal external fatal critical
        looks looking functionality necessary instructions full possible solution solutions trouble shoot troubleshooting undefined attackers private suspended hosting charts persists persist continue continues proceed offered closed disabled gone appears nothing""",
    "de": """
        seite seiten webseite website startseite url link adresse browser server dienst service anfrage anforderung ressource dokument artikel meldung inhalt inhalte datei fehler fehlercode problem probleme technische technischen code status nachricht vorgang referenz kennung bitte leider entschuldigung entschuldigen unannehmlichkeiten versuchen versuch erneut später nochmals einmal augenblick minuten sekunden stunden kürze laden lade neu aktualisieren prüfen überprüfen klicken verwenden nutzen besuchen zurück suche suchen angeforderte angeforderten angefordert gewünschte gesuchte eingegebene eingegeben
        anmelden anmeldung angemeldet konto passwort sitzung abgelaufen zugriff zugang zugänglich berechtigung rechte erlaubt gesperrt blockiert anzeigen angezeigt laden geladen lesen öffnen bearbeitet verarbeitet aktivieren aktivieren aktiviert deaktiviert einschalten eingeschaltet ausgeschaltet schalten skripte skript javascript cookies einstellungen erforderlich benötigt benötigen erfordert anwendung app funktioniert korrekt richtig unterstützt version aktuelle kontaktieren wenden kontakt support hilfe administrator betreiber kundendienst team wartung wartungsarbeiten vorübergehend derzeit momentan nicht verfügbar erreichbar existiert gefunden verschoben entfernt gelöscht umbenannt falsch ungültig land region mitglieder abonnenten abonnement roboter mensch sicherheit verbindung netzwerk internet wegen inhalts""",
    "fr": """
        page pages site web adresse url lien navigateur serveur service requête demande demandée demandé ressource document article note contenu fichier erreur erreurs problème problèmes technique techniques code statut message référence identifiant veuillez désolé désolés excuser excusez gêne désagrément réessayer réessayez nouveau plus tard instant instants minutes secondes heures recharger rechargez actualiser actualisez vérifier vérifiez cliquer cliquez utiliser visiter retour accueil recherche recherchée rechercher saisie saisi tapé
        connecter connexion connecté reconnecter compte passe session expiré accès accéder autorisation droits permis bloqué afficher affichée affiché voir charger chargée chargé lire ouvrir traiter activer activez activé désactivé désactivés désactivée javascript scripts script cookies paramètres nécessaire nécessite requis besoin application fonctionner fonctionne correctement prend charge version contacter contactez assistance support aide administrateur équipe maintenance momentanément temporairement actuellement indisponible disponible existe existe trouvée trouvé déplacée supprimée supprimé incorrecte invalide pays région membres abonnés abonnement robot humain sécurité réseau internet cause""",
    "es": """
        página páginas sitio web dirección url enlace navegador servidor servicio solicitud petición solicitada solicitado recurso documento artículo nota contenido archivo error errores problema problemas técnico técnicos código estado mensaje referencia identificador favor lo sentimos disculpe disculpen molestias inténtelo intente intentar intentarlo nuevo más tarde momento minutos segundos horas recargar recargue actualice actualizar compruebe verifique haga clic usar utilizar visite volver vuelva inicio búsqueda buscar busca buscada escrita escrito
        sesión iniciar cuenta contraseña caducado expirado acceso acceder permiso permisos bloqueado mostrar cargar leer abrir procesar activar active actívelos activado desactivado desactivados habilitar habilite deshabilitado javascript scripts script cookies configuración necesario necesita requiere aplicación funcionar funciona correctamente compatible versión contacto contacte póngase soporte ayuda administrador equipo mantenimiento temporalmente momentáneamente actualmente disponible existe encontrada encontrado movida eliminada eliminado incorrecta inválida país región socios miembros suscriptores suscripción robot humano seguridad red internet tareas ver abierta abierto""",
    "it": """
        pagina pagine sito web indirizzo url link browser server servizio richiesta richiesto risorsa documento articolo contenuto file errore errori problema problemi tecnico tecnici codice stato messaggio riferimento prego preghiamo spiacenti scusa scusiamo disagio riprova riprovare nuovo più tardi momento minuti secondi ricarica ricaricare aggiorna aggiornare verifica verificare controlla controllare clicca usa visita torna tornare indietro home ricerca cercare cercando accesso accedi accedere account password sessione scaduta permesso permessi bloccato visualizzare mostrare caricare leggere aprire attiva attivare abilita abilitare disattivato javascript script cookie impostazioni necessario richiede applicazione funziona funzionare correttamente supportato contatta contattare assistenza supporto amministratore manutenzione temporaneamente attualmente momentaneamente disponibile esiste trovata trovato spostata rimossa rimosso paese abbonati robot umano sicurezza connessione rete internet""",
    "pt": """
        página páginas site web endereço url link navegador servidor serviço solicitação pedido solicitada recurso documento artigo conteúdo ficheiro arquivo erro erros problema problemas técnico técnicos código estado mensagem referência favor desculpe lamentamos pedimos desculpas incómodo tente tentar novamente mais tarde momento minutos segundos recarregue recarregar atualize atualizar verifique verificar clique utilize visite voltar volte início pesquisa procura procurar encontrar acesso aceder acessar conta senha sessão login permissão bloqueado mostrar carregar ler abrir ative ativar habilite habilitar desativado javascript scripts cookies configurações necessário requer aplicação aplicativo funcionar funciona corretamente suportado contacte contato suporte ajuda administrador manutenção temporariamente atualmente momento disponível existe encontrada encontrado movida removida país assinantes robô humano segurança ligação conexão rede internet""",
    "nl": """
        pagina pagina's site website adres url link browser server dienst verzoek aanvraag opgevraagde gevraagde bron document artikel inhoud bestand fout fouten probleem problemen technische code status bericht alstublieft helaas sorry excuses ongemak probeer opnieuw later moment minuten seconden vernieuw vernieuwen herlaad controleer klik gebruik bezoek terug startpagina zoeken zoekt inloggen aanmelden ingelogd account wachtwoord sessie toegang toestemming geblokkeerd weergeven geladen laden lezen openen inschakelen ingeschakeld uitgeschakeld schakel javascript scripts cookies instellingen vereist nodig applicatie werkt werken correct ondersteund contact neem helpdesk beheerder onderhoud tijdelijk momenteel beschikbaar bestaat gevonden verplaatst verwijderd land abonnees robot mens beveiliging verbinding netwerk internet""",
}

FILLER_PHRASES = """
    lorem ipsum|dolor sit amet|placeholder text|placeholder content|dummy text|dummy content|dummy entry|dummy copy|sample text|sample content|sample headline|sample subhead|sample heading|sample title|sample paragraph|sample body|sample page|example text|filler text|blind text|greeked text|your text here|your content here|your title here|your headline here|text goes here|content goes here|copy goes here|title goes here|headline goes here|description goes here|body goes here|goes here|insert text|insert your|insert content|insert copy|enter your text|enter text here|type your text|type here|add your text|add your content|add text here|add a description|add a short description|add a second|add a title|add a sentence|add a source|write your|write a short|write something|replace this text|replace this paragraph|replace with your|be replaced before|to be supplied|to be written|to be added|to be completed|copy to come|text to come|content coming soon|coming soon|content to follow|content will follow|test test test|this is a test|just a test|testing testing|asdf|qwerty|hjkl|foo bar|foobar|bla bla|blah blah|delete this line|delete this text|delete this paragraph|edit this text|click to edit|click edit button|nothing to read|only shows the layout|body to be supplied
    blindtext|platzhaltertext|platzhalter|mustertext|beispieltext|beispielüberschrift|fülltext|dummytext|ihr text|ihren text|ihr inhalt|ihren inhalt|hier steht|text folgt|inhalt folgt|folgt in kürze|wird später ersetzt|wird noch ersetzt|bitte ersetzen
    texte provisoire|texte d'exemple|titre d'exemple|paragraphe d'exemple|texte de remplissage|faux texte|faux-texte|votre texte|votre contenu|votre titre|contenu à venir|texte à venir|bientôt disponible|saisissez votre|insérez votre|ajoutez votre|à compléter
    texto de relleno|texto de ejemplo|texto de prueba|título de ejemplo|párrafo de ejemplo|texto provisional|texto simulado|su texto|tu texto|su contenido|tu contenido|su título|escriba aquí|escribe aquí|contenido disponible próximamente|próximamente|inserte aquí|inserte su|añada su|añade tu
    testo segnaposto|testo di esempio|testo di prova|il tuo testo|inserisci qui|inserisci il|contenuto in arrivo|prossimamente|texto de exemplo|texto provisório|o seu texto|seu texto|insira aqui|insira o|conteúdo em breve|em breve|voorbeeldtekst|opvultekst|uw tekst|jouw tekst|tekst komt hier|binnenkort beschikbaar|plaats hier"""

#: Each kind goes with each part.
FILLER_KINDS = ("placeholder", "dummy", "sample", "filler", "example")
FILLER_PARTS = ("text", "content", "copy", "title", "headline", "heading", "subheading", "description", "paragraph", "sentence", "caption", "body", "summary", "entry", "page", "post")

FILLER_WORDS = """
    placeholder dummy sample example filler blind text texts copy content contents headline heading subhead subheading title titles body paragraph paragraphs sentence sentences description caption summary section line lines word words layout template design mockup demo demonstration draft page post entry note desk author editor source image photo test testing check here goes add insert enter type write replace replaced delete edit keep remove short two three second first published publication publishing publish before purposes purpose only shows show created supplied later soon coming come follow follows will section nothing read real actual final own about please button click change changed company profile product market overview introduction intro biography bio news blog comment
    text texte inhalt überschrift titel absatz beschreibung abschnitt zeile satz muster beispiel platzhalter ohne hier steht folgt kürze später ersetzt ersetzen ersetzt dies einfügen ein geben fügen schreiben löschen vorlage
    texte contenu titre sous-titre paragraphe description rubrique section ligne phrase exemple provisoire sans ici venir bientôt saisissez insérez ajoutez remplacer remplacé remplacez modèle
    texto contenido título subtítulo párrafo descripción sección línea frase ejemplo relleno sin aquí próximamente disponible escriba inserte añada reemplazar reemplazado sustituir modelo
    testo contenuto titolo paragrafo descrizione sezione riga esempio segnaposto qui arrivo inserisci sostituire conteúdo parágrafo descrição seção secção linha exemplo aqui breve insira substituir tekst inhoud kop alinea beschrijving regel voorbeeld hier plaats vervang"""

#: Function words: no content letters, and absent from filler Latin.
FUNCTION_WORDS = frozenset("""
    a an the this that these those it its it's he she they them their we us our you your i me my and or but nor so if then than as of to in on at by for from with without into over under about after before between during through out up down off is are was were be been being am isn't aren't wasn't do does did doesn't don't didn't has have had haven't hasn't will would shall should can could may might must cannot can't couldn't not no any all some more most each other such only also very just too there here what which who whom whose when where why how again once that's there's you're we're they're we've i'm because while until however yet still now
    der die das den dem des ein eine einen einem einer eines und oder aber nicht kein keine keinen ist sind war waren wird werden wurde wurden hat haben hatte hatten sein seine ihr ihre ihren ihrem ihrer sie er es wir uns ich mich du auf aus bei mit nach von vom zu zum zur in im am an für über unter um durch gegen ohne vor als wie wenn ob dass daß weil da so auch nur noch schon sehr mehr kann können muss müssen soll sich dies diese dieser dieses diesem diesen hier dort
    le la les l un une des du de d et ou mais ne pas plus que qui quoi dont où ce cet cette ces il elle ils elles on nous vous je tu son sa ses leur leurs votre vos notre nos mon ma mes en dans sur sous avec sans pour par au aux à est sont était être a ont avait avoir si comme c n s j qu y se
    el los las lo uno una unos unas del al y o pero no que quien cual cuyo donde cuando como si se su sus le les nos os me te mi mis tu tus en con sin por para sobre entre desde hasta hacia a ante es son era eran ser está están ha han había haber más muy ya también este esta esto estos estas ese esa eso
    il lo gli i un uno una dei delle degli del della dello dell di da dal dalla nel nella nell in su sul sulla con per tra fra e ed o ma non che chi cui dove come se si è sono era essere ha hanno ho al alla allo alle agli questo questa questi queste quello quella più anche
    o os as um uma uns umas do da dos das no na nos nas ao aos à às em com sem por para pelo pela sobre entre e ou mas não que quem onde como se seu sua seus suas este esta isto esse essa foi foram ser é são está estão tem têm há mais muito já também
    de het een en of maar niet geen is zijn was waren wordt worden werd werden heeft hebben had dat die dit deze wie wat waar hoe als dan er we wij u uw je jij hij zij ze op in aan bij met van voor naar uit over onder door om te tot tegen zonder ook nog al meer kan kunnen moet moeten""".split())

#: Words of those who write about such pages: with one of them a text is a report.
REPORT_WORDS = frozenset("he she his her him said says reporters spokesman spokeswoman spokesperson according complained sagte sagten teilte erklärte berichtete sprecher sprecherin laut selon déclaré indiqué annoncé porte-parole dijo dijeron según informó explicó portavoz detto secondo portavoce disse segundo afirmou porta-voz zei zeiden volgens woordvoerder".split())

#: The words of the common filler paragraph, and endings of Latin words.
LATIN = frozenset("lorem ipsum dolor sit amet consectetur consectetuer adipiscing elit sed do eiusmod tempor incididunt ut labore et dolore magna aliqua enim ad minim veniam quis nostrud exercitation ullamco laboris nisi aliquip ex ea commodo consequat duis aute irure in reprehenderit voluptate velit esse cillum fugiat nulla pariatur excepteur sint occaecat cupidatat non proident sunt culpa qui officia deserunt mollit anim id est laborum vivamus vestibulum curabitur pellentesque suspendisse vel nec nunc donec integer quam".split())
LATIN_ENDING = re.compile(r"(?:[aeiou]?[mr]|us|is|as|os|es|a|ae|i|it|at|et|nt|quam)$")

# --- placeholders ------------------------------------------------------------------------------------------------

_NAME = r"[^\W\d_][\w.\-]*(?: [\w.\-]+)*"
#: By the sign a placeholder begins with: its full syntax.
_FORMS = {
    "{{": re.compile(rf"\{{\{{\s*[#/^&>]?\s*{_NAME}(?:\s*\|[^{{}}()\n]*)?\s*\}}\}}"),
    "{%": re.compile(r"\{%-?\s*\w+[^{}%\n]*%\}"),
    "<%": re.compile(r"<%[=-]?[^<>%\n]+%>"),
    "${": re.compile(r"\$\{\s*[a-zà-ÿ][\w.]*\s*\}"),
    "#{": re.compile(r"#\{\s*[^\W\d_][\w.]*\s*\}"),
    "%(": re.compile(rf"%\({_NAME}\)[sdrf]"),
    "%": re.compile(r"%[A-Z][A-Z_]+%"),
    "$": re.compile(r"\$[A-Z][A-Z_]+\$"),
    "__": re.compile(r"__[A-Z][A-Z_]*?[A-Z]__"),
    "@@": re.compile(r"@@[\w.]+@@"),
    "[[": re.compile(rf"\[\[\s*{_NAME}\s*\]\]"),
    "<<": re.compile(rf"<<\s*{_NAME}\s*>>"),
    "[": re.compile(r"\[\s*(?P<inner>[^\[\]\n]+?)\s*\]"),
    "{": re.compile(rf"\{{(?:{_NAME}|\d+)\}}(?!\}})"),
    "<": re.compile(rf"<(?P<inner>{_NAME})>"),
    "#": re.compile(r"#(?:REF!|N/A|VALUE!|NAME\?|DIV/0!|NULL!|NUM!)"),
    "____": re.compile(r"_{4,}"),
    "XX": re.compile(r"X{2,}(?:[.,]X+)+"),
}
_SIGNS = ("{{", "{%", "<%", "${", "#{", "%(", "@@", "[[", "<<", "[", "{", "____", "object object")
_WORDS = ("null", "undefined", "nan", "none", "nil")

HTML = frozenset("html head body p br div span a b i em strong ul ol li dl dt dd h1 h2 h3 h4 h5 h6 table tr td th thead tbody tfoot caption img picture figure figcaption pre code samp kbd var title meta link script noscript style form input label select option textarea button nav header footer section article aside main hr sub sup small u s q cite blockquote iframe svg path video audio source canvas mark time details summary".split())
#: What a field may be called; marks of a transcript or a redaction are no fields.
_FIELDS = frozenset("name firstname lastname fullname user username customer client company companyname firm ticker symbol date time day month year quarter period price amount number value total title headline author analyst editor reporter city town country state address email phone url link currency percent percentage rate source series sector region product position event order id published start end close closing report revenue subject department recipient signature code location organization organisation employee employer account balance "
    "firma unternehmen kurs datum betrag ort titel kunde vorname nachname nom prénom société societe entreprise cours montant ville titre empresa nombre fecha precio importe ciudad título azienda nome data prezzo importo preço cidade bedrijf naam bedrag".split())
_MARKS = frozenset("applause laughter laughs music inaudible indiscernible crosstalk silence pause cheering cheers sic redacted censored expletive deleted removed illegible unclear breaking update updated corrected exclusive video photo image advertisement".split())
#: First words of an instruction in brackets, and last words of one.
_SLOT_FIRST = frozenset("your insert enter add type name tbd todo tbc xxx votre vos insérer entrer nom su tu insertar introducir nombre ihr ihre ihren einfügen name eintragen inserire nome inserir".split())
_SLOT_LAST = frozenset("here ici aquí hier einfügen eintragen qui aqui tbd".split())
_BEFORE = frozenset("of for to in at by from with on as near about around until since after before between the a an is was are were be and than versus per dear hello hi von für in im am bei mit auf um zu zum zur nach vor seit bis der die das den dem ist war liegt rund etwa und de du des à au aux en dans sur pour par avec le la les un une est était vers près et del al en por para con desde hasta el los las es era hacia a cerca y di da per nel il lo do da em no na van voor op bij naar met".split())
_UNIT = re.compile(r"\s*(?:%|percent\b|per cent\b|percentage points?\b|points?\b|basis points?\b|bps\b|days?\b|weeks?\b|months?\b|quarters?\b|years?\b|hours?\b|minutes?\b|seconds?\b|sessions?\b|(?:kilo)?met(?:re|er)s?\b|(?:kilo)?grams?\b|kg\b|km\b|tonnes?\b|lit(?:re|er)s?\b|degrees?\b|people\b|passengers?\b|rows?\b|shares?\b|times\b|million\b|billion\b|bn\b|mn?\b|euros?\b|dollars?\b|usd\b|eur\b|prozent\b|punkte?n?\b|tage?n?\b|minuten\b|monate?n?\b|zeilen\b|millionen\b|mrd\b|mio\b|pour cent\b|jours?\b|mois\b|lignes?\b|millions?\b|milliards?\b|por ciento\b|puntos\b|días\b|minutos\b|meses\b|filas\b|millones\b)", re.IGNORECASE)
_GREETING = re.compile(r"(?:^|[.!?\n]\s*|[\"“(]\s*)(?:dear|hello|hi|hey|good (?:morning|afternoon|evening)|welcome|liebe[rs]?|sehr geehrte[rs]?(?: (?:frau|herr))?|hallo|guten (?:tag|morgen|abend)|cher|chère|bonjour|bonsoir|madame|monsieur|estimad[oa]s?|querid[oa]|hola|buenos días|gentile|caro|cara|ciao|buongiorno|prezad[oa]|olá|caro|beste|geachte)\s*$", re.IGNORECASE)
#: Sentences that write about templates, code or formats.
_ABOUT = re.compile(
    r"\b(?:placeholders?|templates?|templating|merge fields?|variables?|syntax|macros?|environment|expands?|expanded|substitut\w+|interpolat\w+|render(?:s|ed)?|fills?|filled|filling|shell|snippet|regex|parser|parses|escape[ds]?|markup|tags?|brackets?|braces|format(?:s|ted)?|replaced|usage|spreadsheets?|formulas?|cells?"
    r"|vorlagen?|platzhaltern?|ersetzt|formatvorlage|modèles?|gabarits?|balises?|remplacée?s?|plantillas?|marcador(?:es)?|sustituyen?|reemplazan?|etiquetas?|segnaposto|modelli|sostituit\w+|marcadores|sjablo(?:on|nen))\b",
    re.IGNORECASE,
)
_CODE = re.compile(r"`|\"\s*:|\w\(|\);|=>|->|==|!=|\+=|&&|\|\||</|/>|::|^\s*(?:\$|>>>|#!|//|/\*|import|from \w+ import|def|class|const|let|var|return|public|private|SELECT|INSERT|UPDATE)\b|\b(?:select|insert into|update) .*\b(?:from|values|set)\b|(?<!\s)=(?!\s)|\s--\w|\s-\w\s")
#: Sayings in which a word for an empty value is a word, looked for right around it; conditions about one.
_SAYINGS = re.compile(r"\bnot a number\b|\bnull (?:values?|checks?|pointers?|and void|und nichtig|zu|hypothes[ie]s|results?|sets?|terminated|island|model)\b|\bnone of\b|\bnone the less\b|\bundefined (?:behaviou?r|variables?|symbols?|references?|terms?)\b|\bnil[- ](?:by|all|nil|return|coupon)\b", re.IGNORECASE)
_EQUALS = re.compile(r"\b(?:is|was|are|were|equals?|be)\s+(?:not\s+)?$", re.IGNORECASE)
_CONDITIONS = frozenset("where when if whether as not non or either".split())
_DATA_TALK = re.compile(r"\b(?:values|columns?|fields?|pandas|python|numpy|dataframes?|json|sql|javascript|parser|nulls|nans|variables?|pointers?|functions?|defaults?|booleans?|datatype|query|schema|constants?|set to|sets|valeurs|colonnes?|werte|spalten?|valores|columnas?)\b", re.IGNORECASE)
_ENGLISH = frozenset("the of and was with for that an by".split())
_GERMAN = frozenset("der die das und ist nicht ein eine einen wurde von auf im bei".split())
_PREPOSITIONS = frozenset("of for in at by from on near about around until since after before between against versus für von im mit seit bis vor nach pour dans sur chez vers depuis en con para por desde hasta hacia nel dal per".split())
#: What follows a value: punctuation, a preposition or conjunction, a verb, a number, another empty value.
_GOES_ON = re.compile(r"\s*(?:[.,;:!?)]|$)|\s(?:null|undefined|NaN|None|nil|\d|and|or|to|from|in|on|at|by|for|of|with|which|as|against|after|before|compared|up|down|was|were|is|are|has|have|had|will|would|came|stood|rose|fell|und|oder|auf|in|im|von|zu|nach|gegen|et|ou|en|à|au|de|du|pour|contre|y|o|a|por|para|contra)\b")
_NOUN_SLOT = re.compile(r"\s(?:series|index|indices|rates?|prices?|quarter|period|company|group|stocks?|shares|symbol|ticker|reihe|kurs|série|cours|serie|índice|precio)\b", re.IGNORECASE)

_ANY_FORM = re.compile(rf"\{{\{{\s*[#/^&>]?\s*{_NAME}(?:\s*\|[^{{}}()\n]*)?\s*\}}\}}|\{{%[^{{}}%\n]*%\}}|<%[^<>%\n]+%>|[$#]\{{[^{{}}\n]*\}}|%\({_NAME}\)[sdrf]|%[A-Z][A-Z_]+%|\$[A-Z][A-Z_]+\$|__[A-Z_]+__|@@[\w.]+@@|\[\[[^\[\]\n]*\]\]|<<{_NAME}>>|\[[^\[\]\n]*\]|\{{(?:{_NAME}|\d+)\}}|<{_NAME}>|_{{3,}}")
_FORMULA = frozenset("error errors cell cells formula formulas spreadsheet".split())
_BREAK = re.compile(r"[.!?] |\n")
_SPLIT = re.compile(r"(?<=[.!?…])\s+|\n+")
#: A phrase behind one of these tells when a page is shown.
_WHEN = re.compile(r"\b(?:when|whenever)\b")
_SPACES = re.compile(r"[^\S\n]+")
_MARKUP = re.compile(r"</?[a-z][a-z0-9]*(?:\s[^<>]*)?/?>", re.IGNORECASE)
_NAVIGATION = re.compile(r"^\s*[^|\n.]+?(?:\s[|›»·>/•]\s[^|\n.]+?){2,}\s*$")
_TOKEN = re.compile(r"[^\W_][\w'’.\-/:@]*")
_LETTER = re.compile(r"[^\W\d_]")


def _words(lists: dict[str, str] | str) -> frozenset[str]:
    return frozenset(" ".join(lists.values()).split() if isinstance(lists, dict) else lists.split())


ERROR_VOCABULARY, FILLER_VOCABULARY = _words(ERROR_WORDS), _words(FILLER_WORDS)


def _phrases(text: str) -> list[str]:
    return [p.strip() for line in text.strip().splitlines() for p in line.split("|") if p.strip()]


@lru_cache(maxsize=1)
def automaton() -> ahocorasick.Automaton:
    """One automaton over phrases and signs; a value is (length, kind): e error phrase, f filler phrase, s sign of a placeholder, w word for an empty value."""
    found: dict[str, str] = {}
    for text in ERROR_PHRASES.values():
        found |= {p: "e" for p in _phrases(text)}
    found |= {f"{a} {b}": "f" for a in FILLER_KINDS for b in FILLER_PARTS} | {f"your {b} here": "f" for b in FILLER_PARTS} | {f"your {b} goes": "f" for b in FILLER_PARTS}
    found |= {p: "f" for p in _phrases(FILLER_PHRASES)} | {p: "s" for p in _SIGNS} | {p: "w" for p in _WORDS}
    for status in HTTPStatus:
        if status >= 400:
            found |= {f"{status.value}{by}{status.phrase.lower()}": "e" for by in (" ", ": ", " - ")}
    letters = "abcdefghijklmnopqrstuvwxyz"
    found |= {f"{sign}{x}": "s" for sign in ("%", "$", "__", "<") for x in letters} | {f"#{x}": "s" for x in "rnvd"} | {"xx.": "s", "xx,": "s"}
    a = ahocorasick.Automaton()
    for p, kind in found.items():
        a.add_word(p, (len(p), kind))
    a.make_automaton()
    return a


def _hits(low: str) -> dict[str, list[tuple[int, int]]]:
    """Spans of the automaton's finds by kind; phrases and words on word borders."""
    out: dict[str, list[tuple[int, int]]] = {"e": [], "f": [], "s": [], "w": []}
    n = len(low)
    for end, (length, kind) in automaton().iter(low):
        start = end - length + 1
        if kind != "s" and ((start and low[start - 1].isalnum()) or (end + 1 < n and low[end + 1].isalnum())):
            continue
        out[kind].append((start, end + 1))
    return out


def _share(part: str, spans: list[tuple[int, int]], vocabulary: frozenset[str], at: int = 0) -> float:
    """Share of the content letters of ``part`` (which starts at ``at``) that lie in spans or in words of the vocabulary."""
    inside = bytearray(len(part))
    for a, b in spans:
        a, b = max(a - at, 0), min(b - at, len(part))
        if a < b:
            inside[a:b] = b"\x01" * (b - a)
    content = covered = 0
    for m in _TOKEN.finditer(part):
        word = m.group().rstrip(".'’:-/")
        a, b = m.start(), m.start() + len(word)
        if inside[a]:
            content += b - a
            covered += b - a
            continue
        if word in FUNCTION_WORDS or any(c.isdigit() or c in "_./@:" for c in word):
            continue  # function words, numbers, identifiers and addresses are no content
        if len(word) > 1:
            content += b - a
            if word in vocabulary or word.endswith(("error", "exception")):
                covered += b - a
    return covered / content if content else 0.0


def error_coverage(low: str, spans: list[tuple[int, int]]) -> float:
    """Coverage of a text by error phrases and vocabulary: the best of the text with and without its opening line; 0 for reports.

    Without a phrase only the whole text counts, and not in part."""
    if spans and sum(b - a for a, b in spans) < LEAST_PHRASES * len(low):
        return 0.0
    kept = [(a, b) for a, b in spans if not _WHEN.search(low, max(low.rfind(".", 0, a), low.rfind("\n", 0, a), a - 80, 0), a)]
    if spans and not kept:
        return 0.0
    spans = kept
    blank = _MARKUP.sub(lambda m: " " * len(m.group()), low)
    lines, at = [], 0
    for line in blank.split("\n"):
        if line.strip() and not _NAVIGATION.match(line):
            lines.append((at, line))
        at += len(line) + 1
    best = 0.0
    for part in (lines, lines[1:]) if spans else (lines,):
        if not part:
            continue
        first = part[0][0]
        whole = "".join(line.ljust(b - a) for (a, line), b in zip(part, [x for x, _ in part[1:]] + [part[-1][0] + len(part[-1][1])]))
        if (not spans or any(a >= first for a, _ in spans)) and REPORT_WORDS.isdisjoint(w.strip(".,;:!?\"'()") for w in whole.split()):
            best = max(best, _share(whole, spans, ERROR_VOCABULARY, first))
    return best


def _in_vocabulary(low: str) -> bool:
    """Whether so many words of a text are function words or vocabulary of failed pages that it is worth measuring."""
    words = [w.strip(".,;:!?\"'()…") for w in low.split()]
    known = sum(w in ERROR_VOCABULARY for w in words)
    return known >= VOCABULARY_WORDS and known + sum(w in FUNCTION_WORDS and w not in ERROR_VOCABULARY for w in words) >= 0.8 * len(words)


def _sentences(text: str) -> list[tuple[int, str]]:
    out, at = [], 0
    for m in _SPLIT.finditer(text):
        out.append((at, text[at : m.start()]))
        at = m.end()
    out.append((at, text[at:]))
    return out


def is_latin(sentence: str) -> bool:
    """Whether a sentence has no function word of a living language and its words look like filler Latin."""
    words = [w for w in (x.strip(".,;:!?\"'()") for x in sentence.split()) if w]
    if len(words) < LATIN_WORDS or not all(w.isalpha() for w in words):
        return False
    if sum(w[0].isupper() for w in words) > 1 + len(words) // 4:
        return False  # a list of names
    lower = [w.lower() for w in words]
    if any(w in FUNCTION_WORDS and w not in LATIN for w in lower):
        return False
    return sum(w in LATIN or (len(w) > 2 and LATIN_ENDING.search(w) is not None) for w in lower) >= LATIN_SHARE * len(words)


def has_filler(text: str, low: str, spans: list[tuple[int, int]]) -> bool:
    """Whether a whole sentence is filler: by phrases that cover it or as filler Latin."""
    for at, sentence in _sentences(text):
        own = [(a, b) for a, b in spans if a < at + len(sentence) and b > at]
        if own and _share(low[at : at + len(sentence)], own, FILLER_VOCABULARY, at) >= FILLER_COVERAGE:
            return True
        if len(sentence) > 12 and is_latin(sentence):
            return True
    return False


class _Prose:
    """A text with its sentences, each looked at once however many signs it holds."""

    def __init__(self, text: str):
        self.text = text
        self.starts = [0, *(m.end() for m in _BREAK.finditer(text))]
        self.seen: dict[int, tuple] = {}

    def sentence(self, at: int) -> tuple[bool, bool, frozenset[str], tuple[int, int], bool]:
        """Of the sentence around a position: whether it writes about templates, whether it is code, its words, how many and how many small ones, whether it talks of data."""
        i = bisect_right(self.starts, at) - 1
        if i not in self.seen:
            start = self.starts[i]
            whole = self.text[start : self.starts[i + 1] if i + 1 < len(self.starts) else len(self.text)]
            rest = _MARKUP.sub(" ", _ANY_FORM.sub(" ", whole))
            words = re.findall(r"[^\W\d_]+", rest)
            shares = (len(words), sum(w[0].islower() for w in words))
            self.seen[i] = (_ABOUT.search(rest) is not None, _CODE.search(rest) is not None, frozenset(w.lower() for w in words), shares, _DATA_TALK.search(rest) is not None)
        return self.seen[i]


def _before(text: str, start: int) -> str:
    """The word directly before; empty at the start of a line or behind punctuation."""
    m = re.search(r"([^\W\d_][\w']*)[ (\"“]*$", text[max(0, start - 40) : start])
    return m.group(1) if m else ""


def _empty_word(doc: _Prose, start: int, end: int) -> bool:
    """Whether a word for an empty value stands where a value belongs."""
    text = doc.text
    word = text[start:end]
    if word not in ("null", "undefined", "NaN", "None", "nil"):
        return False
    left, right = text[max(0, start - 60) : start], text[end : end + 60]
    if re.search(r"[\"'`<>=/(\[{|]\s?$|[.:]$|: $", left) or re.match(r"[\"'`<>=/)\]}(|]|\.\w|-\w", right):
        return False  # code, markup or a table
    _, code, own, _, data_talk = doc.sentence(start)
    if code or _SAYINGS.search(text[max(0, start - 8) : end + 16]) or (_EQUALS.search(left) and not _CONDITIONS.isdisjoint(own)):
        return False
    english, german = not _ENGLISH.isdisjoint(own), not _GERMAN.isdisjoint(own)
    if _GREETING.search(left) or re.search(r"[$€£¥]\s?$", left):
        return True
    if _UNIT.match(right):
        return word != "null" or english or not german  # null is a number in German
    if not left.strip() or re.search(r"[.!?]\s+$|\n\s*$", left):  # a sentence doesn't start with a small letter
        return word in ("null", "undefined", "NaN") and re.match(r"\s[a-z]+", right) is not None and not re.match(r"\s(?:is|are|was|means?|stands?|or|and|as|in|if)\b", right)
    before = _before(text, start)
    if not before or data_talk:
        return False
    if before.islower() and (word in ("None", "NaN") or (word == "undefined" and not english) or (word == "null" and not english and not german)):
        return True  # a capital within a sentence, or no word of the language
    if word in ("null", "None", "NaN") and before.lower() in _PREPOSITIONS:
        return True
    return before.lower() in _BEFORE and (_GOES_ON.match(right) is not None or _NOUN_SLOT.match(right) is not None)


def _is_slot(doc: _Prose, sign: str, m: re.Match) -> bool:
    """Whether a placeholder with full syntax stands where a value belongs."""
    text = doc.text
    start, end = m.span()
    about, code, words, (count, small), _ = doc.sentence(start)
    before = text[start - 1] if start else " "
    greeting = _GREETING.search(text[max(0, start - 60) : start]) is not None
    if sign in ("<", "{", "[", "____", "XX", "$", "%", "__") and (before.isalnum() or before in "_\"'`=/\\"):
        return False
    if about and not greeting:
        return False
    if code or (sign == "{" and before in "$#%{"):
        return False
    if sign == "<":
        inner = m["inner"]
        if inner.split()[0].lower() in HTML or "/" in inner:
            return False
        if re.match(r"\s*[,;:/|\t.-]?\s*[<\[]", text[end : end + 4]) or re.search(r"[>\]]\s*[,;:/|\t.-]?\s*$", text[max(0, start - 4) : start]):
            return False  # a row of them is a format
        return re.match(r"[\w/=@]|\.\w", text[end : end + 2]) is None and not re.search(r"\b(?:where|with)\s+$", text[max(0, start - 8) : start])
    if sign == "[":
        inner = m["inner"]
        parts = inner.lower().split()
        if inner in ("object Object",):
            return True
        if parts[0].strip(":") in ("tbd", "todo", "tbc", "xxx"):
            return True
        if len(parts) > 1 and (parts[0] in _SLOT_FIRST or parts[-1] in _SLOT_LAST):
            return True
        if greeting:
            return not inner[0].isdigit()
        if inner.split()[0] in ("HERE", "HIER", "ICI", "AQUÍ", "QUI", "AQUI") and len(parts) > 1:
            return True
        shouted = len(inner) > 2 and inner == inner.upper() and re.fullmatch(r"[^\W\d][^\W\d_ .\-]*(?:[_ .\-][^\W\d]+)*", inner) is not None
        named = re.split(r"[_ .\-]+", inner.lower())
        if not shouted or not _MARKS.isdisjoint(named):
            return False
        word, right = _before(text, start), text[end : end + 40]
        field = any(f in _FIELDS or any(f.startswith(x) or f.endswith(x) for x in _FIELDS if len(x) > 3) for f in named)
        if field and (word.islower() or re.match(r"\s[a-zà-ÿ]", right) or (text[max(0, start - 2) : start] == ", " and right[:1] in ",.;")):
            return True
        return word.lower() in _BEFORE or _UNIT.match(right) is not None or re.search(r"[\]})>%@]\s$", text[max(0, start - 2) : start]) is not None
    if sign == "____":
        own = text[max(0, start - 60) : start]
        prose = count >= 4 and small * 3 >= count
        opens = re.search(r"(?:^|[.!?;,]\s|\n)\s*$", own) is not None and re.match(r"\s[a-zà-ÿ]", text[end : end + 2]) is not None
        before = _before(text, start)
        within = (before.islower() or before.lower() in FUNCTION_WORDS or own.endswith("(")) and re.match(r"\s[^\W\d_]|[.,)]\s|[.,]?$|%", text[end : end + 3]) is not None
        return greeting or (prose and (opens or within))
    if sign == "#":
        return _FORMULA.isdisjoint(words)
    return True


def unfilled(text: str, hits: dict[str, list[tuple[int, int]]]) -> str | None:
    """The first value that was never filled in, or None."""
    doc = _Prose(text)
    for start, end in hits["s"]:
        opener = text[start:end]
        if opener.lower() == "object object":
            if start and text[start - 1] == "[":
                return text[start - 1 : end + 1]
            continue
        for sign in (opener, opener[:2], opener[:1]):
            form = _FORMS.get(sign.upper() if sign in ("xx", "XX") else sign)
            if form is None:
                continue
            m = form.match(text, start)
            if m and _is_slot(doc, sign.upper() if sign == "xx" else sign, m):
                return m.group()
            if m:
                break
    for start, end in hits["w"]:
        if _empty_word(doc, start, end):
            return text[start:end]
    return None


def classify(text: str | None) -> tuple[str | None, float]:
    """(kind, error coverage) of a text: placeholder, filler, error_page or None. Null, empty and blank texts are no cases."""
    if text is None or not text.strip():
        return None, 0.0
    text = _SPACES.sub(" ", text.replace("’", "'").replace("İ", "I"))
    low = text.lower()
    hits = _hits(low.replace("\n", " "))
    coverage = error_coverage(low, hits["e"]) if hits["e"] or _in_vocabulary(low) else 0.0
    if coverage >= (ERROR_COVERAGE if hits["e"] else VOCABULARY_ALONE):
        return "error_page", coverage
    if (hits["s"] or hits["w"]) and unfilled(text, hits) is not None:
        return "placeholder", coverage
    if has_filler(text, low, hits["f"]):
        return "filler", coverage
    return None, coverage


@F.pandas_udf(StructType([StructField("residue", StringType()), StructField("coverage", DoubleType())]))
def _verdict(texts: pd.Series) -> pd.DataFrame:
    found = [classify(t) for t in texts]
    return pd.DataFrame({"residue": pd.Series([k for k, _ in found], dtype="object"), "coverage": [c for _, c in found]})


def verdict(text_col: str = "text") -> Column:
    """struct<residue, coverage> of a text column; residue is null for real content.

    Declared as not deterministic, so that a filter on it isn't pushed below it and judges every text again.
    """
    return _verdict.asNondeterministic()(F.col(text_col))


def judge(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, residue (null: real content), coverage; one row per document, repeated rows repeated.

    Null, empty and blank texts are no cases; texts of any length are read whole;
    an empty table gives no rows; other columns are ignored.
    """
    return documents.select(F.col(id_col), verdict(text_col).alias("_v")).select(id_col, "_v.residue", "_v.coverage")


def exclude(documents: DataFrame, text_col: str = "text") -> DataFrame:
    """The documents that hold real content, all columns kept: those whose verdict has no residue."""
    return documents.where(verdict(text_col)["residue"].isNull())
