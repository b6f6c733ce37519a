"""Labelled training text for the tagger: personal information in sentences, forms, logs and code, and what looks like it but
is not.

Everything is written from general knowledge of names, number formats, postal addresses and file formats; most words of
names, streets, towns and domains are made up from syllables, so that the tagger learns forms and contexts, not lists.
"""

from __future__ import annotations

import random
import re

GIVEN = "James Linda Michael Patricia William Barbara Richard Susan Joseph Jessica Thomas Sarah Charles Karen Daniel Nancy Matthew Betty Anthony Sandra Donald Ashley Steven Emily Andrew Michelle Joshua Carol Kenneth Amanda Kevin Melissa Brian Deborah Timothy Stephanie Ronald Rebecca George Laura Jason Helen Edward Sharon Ryan Cynthia Jacob Kathleen Hans Ursula Wolfgang Petra Stefan Claudia Günter Sabine Uwe Heike Pierre Nathalie Jean-Luc Isabelle Benoît Céline Thierry Amélie Carlos Pilar Alejandro Rocío Javier Inés Núria Giulia Lorenzo Chiara Matteo Agnieszka Krzysztof Magdalena Tomasz Irina Sergei Olga Nikolai Svetlana Hiroshi Yuki Takeshi Akiko Wei Xiaoming Ling Jing Min-jun Ji-woo Rajesh Ananya Vikram Deepika Arjun Fatima Mohammed Layla Hassan Zainab Ahmed Chidi Ngozi Kofi Abena Lars Bjarne Astrid Anneli Jorge Thiago Beatriz Zoltán Eszter Dragana Milan Elif Mehmet Aoife Niamh Rhys Sinéad Grant Hope Faith Iris Jade Ruby Daisy Violet Frank Ernest Miles Hunter Mason Carter Sage Summer Autumn Ivy Lily Jasmine Amber Pearl Chase Chance".split()
FAMILY = "Johnson Williams Brown Jones Miller Davis Wilson Anderson Taylor Moore Jackson Martin Thompson White Harris Clark Lewis Robinson Walker Young Allen King Wright Scott Hill Green Adams Baker Nelson Carter Mitchell Roberts Turner Phillips Campbell Parker Evans Edwards Collins Stewart Morris Rogers Reed Cook Morgan Bell Murphy Bailey Cooper Richardson Cox Howard Ward Peterson Gray Watson Brooks Kelly Sanders Price Bennett Wood Barnes Ross Henderson Coleman Jenkins Perry Powell Long Hughes Fischer Weber Meyer Wagner Becker Schulz Hoffmann Schäfer Koch Bauer Richter Wolf Schröder Neumann Zimmermann Krüger Bernard Dubois Durand Leroy Moreau Lefèvre Girard Mercier Fernández Rodríguez Martínez Sánchez Gómez Jiménez Moreno Álvarez Ferrari Esposito Ricci Kowalski Wiśniewski Kamiński Ivanov Petrov Smirnova Tanaka Suzuki Watanabe Zhang Wang Liu Chen Nguyen Tran Kim Park Sharma Patel Gupta Singh Khan Hussain Okafor Adeyemi Mensah Hansen Johansson Nilsson Andersson Silva Santos Oliveira Nagy Kovács Yılmaz Demir O'Neill O'Sullivan MacLeod McCarthy Fitzgerald".split()
PARTICLES = ["van", "von", "de", "van den", "de la", "del", "di", "al", "bin", "dos", "zu", "van de", "El", "Ben", "La", "Le"]
NOUNS = "parser compiler scheduler cluster database table column schema server client request response payload endpoint router gateway proxy session socket stream topic broker worker thread process kernel driver module package library plugin template renderer widget button dialog layout theme colour image icon file folder path link archive backup snapshot volume disk memory heap stack pointer register buffer pipeline stage task job timer event handler listener callback promise future signal channel mutex counter gauge metric alert dashboard report chart ledger invoice order cart product price discount coupon customer account profile password secret certificate key token role permission group team project branch commit merge release version build test fixture mock coverage lint formatter config flag option variable constant function method class object interface trait struct enum array list map set tree graph node edge path cycle queue index cache".split()
VERBS = "parse compile schedule render fetch store load save merge split sort filter group count check verify validate sign encode decode compress upload download deploy restart stop start pause resume retry cancel close open create delete update rename move copy import export publish archive restore migrate upgrade patch fix refactor rewrite simplify document test".split()
ROLES = "engineer manager director colleague developer architect consultant intern professor doctor lawyer nurse teacher author editor translator treasurer chairman secretary landlord tenant neighbour plaintiff patient passenger speaker CEO CTO CFO owner maintainer contributor reviewer tester analyst recruiter candidate supervisor librarian".split()
DONE = "reported found fixed written reviewed approved rejected suggested requested filed opened closed maintained designed invented discovered described translated edited drawn signed confirmed cancelled prepared presented taught tested deployed broken reverted documented submitted raised answered proposed sponsored drafted audited".split()
SAYS = "said thinks believes wrote asked answered explained noticed told us confirmed claims insists argued remembers agreed replied warned added pointed out mentioned complained".split()
ASKS = ["ask", "call", "contact", "email", "notify", "tell", "remind", "invite", "see", "meet", "thank", "speak to", "talk to", "write to", "reach out to", "check with", "send it to", "forward this to", "assign to", "hand over to", "wait for", "escalate to", "copy in", "introduce", "welcome"]
DAYS = "Monday Wednesday Thursday Friday Saturday Sunday January February March April June August October November December".split()
TITLES = ["Mr", "Mrs", "Ms", "Mr.", "Mrs.", "Ms.", "Dr", "Dr.", "Prof.", "Professor", "Sir", "Miss", "Herr", "Frau", "Madame", "Monsieur", "Mme", "M.", "Señor", "Señora", "Sr.", "Sra.", "Don", "Doña", "Dame", "Captain", "Judge", "Herrn"]
TLDS = "com org net io dev de fr es it nl eu co.uk ac.uk edu gov info biz me ch at pl example test invalid localhost.example example.com example.org".split()
WAYS = "Street Road Lane Avenue Drive Court Place Square Terrace Way Close Crescent Row Hill Gardens Boulevard Parkway Grove Walk Mews St St. Rd Rd. Ave Ave. Ln Dr Blvd Ct Pl".split()
DE_WAYS = ["straße", "strasse", "str.", "weg", "gasse", "platz", "allee", "ring", "ufer", "damm", "zeile", "markt", " Straße", " Allee", " Platz", "steig", "pfad", "hof"]
FR_WAYS = ["rue", "avenue", "boulevard", "chemin", "impasse", "place", "quai", "allée", "cours", "route", "square", "passage"]
ES_WAYS = ["Calle", "C/", "Avenida", "Avda.", "Plaza", "Paseo", "Camino", "Ronda", "Travesía", "Carretera"]

# Contexts of names {N}, email addresses {E}, phone numbers {P}, postal addresses {A}, identity numbers {I} with label {K}.
# Small letters are filled from lists: {n} noun, {v} verb, {d} past participle, {y} verb of saying, {k} asking, {r} role,
# {t} title, {w} day or month, {f} filler sentence, {0} digits, {u} an account name.
HOLDING = [x.replace("\\n", "\n") for x in r"""The {n} was {d} by {N}.
The {n} bug was {d} by {N} in {w}.
{d} by {N}
{d} by {N} and {N}
{d} by {t} {N}
{n} {d} by {N} last {w}
{N} {d} the {n} on {w}.
{N} {d} this
{N} {y} that the {n} is broken.
{N} {y}: {f}
{N} and {N} {y} we should {v} the {n}
According to {N}, the {n} is slow.
According to {N}, {f}
In {w} {N} {y}: {f}
last {w} {N} {d} the {n}
since {w} {N} and {N} {v} the {n} together
TODO({N}) {f}
NOTE({N}): {f}
XXX {N}: {f}
@since 20{0} {N}
{f} {N} {y} so.
{f} {k} {N} for that.
{f} {k} {N} ({P}) when the {n} is down.
{f} Signed, {N}.
{f} The {r} is {N}, {P}.
{f} Reach {N} under {P}.
{f} Write to {E}.
{f} Tel. {P}
{f} {A}
{f} The {n} shows {K} {I}, {f}
{n} of {N}: {f}
the {n} belongs to {N}
{N} owns the {n}
{N} was here
no reply from {N} since {w}
approved: {N}
changed by {N}, seen by {N}
{N} > {N}: {f}
the letter from {N} came on {w}
{N} wrote the {n}; {N} and {N} {v} it
According to {t} {N} we must {v} it first.
As {N} {y}, {f}
please {k} {N} about that {n}
{k} {N} before {w}.
{k} {N} ({E}) or {N}
{k} {N} on {P}
You can {k} {N} at {E} or {P}.
Our {r}, {N}, will {v} the {n}.
Our {r} {N} {y} so.
the {r} is {N}
{N} ({r}) {y} no.
{N}, {r}
{N}, {r} of the {n} team, {y} yes
Name: {N}
name: {N}\nemail: {E}\nphone: {P}
full name = {N}
owner: {N}
{r}: {N}
{r}: {N} <{E}>
From: {N} <{E}>
To: {N} <{E}>, {N} <{E}>
Acked-by: {N} <{E}>
Reported-by: {N}
Tested-by: {N}
Author: {N} <{E}>\nDate: {w} {0}
Copyright (c) 20{0} {N}
# written by {N}, {w} {0}
// {N}: {f}
/* maintainer: {N} {E} */
# FIXME {N} wants to {v} this
# {N} {d} it in {w}
"author": "{N}",
"name": "{N}", "tel": "{P}"
{{"user": "{N}", "mail": "{E}", "address": "{A}"}}
{{"firstName": "x", "fullName": "{N}", "{K}": "{I}"}}
VALUES ('{N}', '{E}', '{P}');
{N},{E},{P},{0}
{N};{A};{P}
{N}\t{E}\t{P}
| {N} | {E} | {0} |
| {P} | {A} |
FN:{N}\nTEL;TYPE=work:{P}\nEMAIL:{E}
<td>{N}</td><td>{P}</td>
<a href="mailto:{E}">{N}</a>
<{E}>
Dear {N},\n{f}
Hi {N}, {f}
Hello {t} {N},
Thanks, {N}
Many thanks to {N}!
Cheers,\n{N}
Yours sincerely,\n{N}\n{r}\n{A}
{f}\n\n-- \n{N}\n{P}
All the best\n{N}\n{E}
credit goes to {N} for the {n}
{N}'s {n} is gone
it is {N}’s turn to {v}
{N}'s laptop has the {n}
with help from {N} and {N}
a talk by {N} on {n}s
sat with {N} all {w}
I am {N} and I {v} the {n}.
my name is {N}
This is {N} speaking.
we hired {N} as {r}
{t} {N} {y} it
{t} {N} can {v} the {n} on {w}
the patient {N} lives at {A}
{w}: {N} takes over from {N}
on call: {N}, {P}
[{N}] {f}
"{f}" ({N})
{f} - {N}
> {N} {y}:
user {N} logged in from the {n}
Attendees: {N}, {N}, {N}
Present: {N}; {N}; {N}
- {N}: {v} the {n}
* {N}
1. {N}
{N}
{N} / {P}
{N}, {A}
{N}, {E}
email {E} for the {n}
{k} {E}
{k} {E}.
send the {n} to {E} and {E}
mail: {E}
contact={E}
E-mail address: {E}
My address is {E}, {f}
{E} {y} the {n} fails
{E}
user={E} status=ok
{0} rows for {E}
subscribe with {E} today
({E})
questions? {E}
you'll find me under {E} most days
mailto:{E}?subject={n}
bounced: {E}, {E}
tel {P}
Tel.: {P}
phone: {P}
phone={P}
Fax {P}
Mobile: {P}
ring {P} after {w}
dial {P} to {v} the {n}
text {P} or {E}
my number is {P}
call {P}
call us: {P}!
the desk is at {P}, ask for the {r}
support ({P})
T {P} / M {P}
reach the {r} by phone at {P}.
{P}
WhatsApp {P}
switchboard {P} extension {0}
{K} {I}
{K}: {I}
{K}={I}
{K} {I} was in the {n}
the {n} shows {K} {I}
my {K} is {I}
{N}, {K} {I}
{N} ({K} {I}) {y} no
log line with {K} {I} in clear
"{K}": "{I}"
with {K} no. {I}
{I} is a {K}
{I} ({K})
found a {K} ({I}) in the {n}
user {0} has {K} {I}, please {v}
{K} of {N}: {I}
row {0}: {I} looks like a {K}
{n} contains {I}, the {K} of a {r}
holder of {K} {I}
Address: {A}
Postal address:\n{A}
lives at {A}
we moved to {A}
{n} to {A}
bring the {n} to {A} by {w}
our office is at {A}.
visit us: {A}
deliver to {N}, {A}
billing address = {A}
{A}
{A}, {P}
{N}\n{A}\n{P}
from {A} to {A}
the house at {A} is for sale
come to {A} on {w}, {f}
post it to {A}; {f}
Der Fehler wurde von {N} gefunden.
Laut {N} ist die Tabelle leer.
Bitte {N} fragen, Telefon {P}.
Mit freundlichen Grüßen\n{N}
Ansprechpartner: {N}, {E}
Herr {N} und Frau {N} kommen am Montag.
{N} hat das gestern geschrieben.
geprüft von {N}
Anschrift: {A}
Wir sitzen jetzt in {A}.
Schreiben Sie an {E} oder rufen Sie an: {P}
Die Nummer {I} ist eine {K}.
Seine {K} lautet {I}
Wohnhaft in {A}
Post geht an {N}, {A}.
Le bogue a été trouvé par {N}.
Selon {N}, la table est vide.
Merci à {N} pour la correction.
Bien cordialement,\n{N}
Adresse : {A}
Nos bureaux sont au {A}.
Téléphone : {P}
Contactez {N} ({E}) avant lundi.
M. {N} habite {A}
courriel : {E}
le numéro {I} ({K}) est visible
son {K} est {I}
vérifié par {N}
El error lo encontró {N}.
Según {N}, la tabla está vacía.
Gracias a {N} por el parche.
Un saludo,\n{N}
Dirección: {A}
La oficina está en {A}.
Teléfono: {P}
Escriba a {E} o llame al {P}.
Don {N} vive en {A}
su {K} es {I}
el número {I} ({K}) aparece en el registro
aprobado por {N}
Contatto: {N}, {E}
segnalato da {N}
gemeld door {N}
zgłoszone przez {N}""".split("\n")]
LABELS = {
    "ssn": ["SSN", "ssn", "SSN:", "social sec.", "Social Security Number", "US social security no", "soc. sec. no."],
    "tax": ["TIN", "tax ID", "tax id no.", "Steuernummer", "Steueridentifikationsnummer", "Steuer-IdNr.", "NIF", "numéro fiscal", "codice fiscale no.", "taxpayer number", "TFN", "UTR", "fiscal number"],
    "ni": ["NINO", "National Insurance", "National Insurance number", "NI no.", "NI No:", "insurance ID", "health insurance number", "Versicherungsnummer", "numéro d'assuré", "policy holder no."],
    "passport": ["passport number", "passport nr", "Passport:", "Pass-Nr.", "Reisepass", "passeport", "pasaporte", "passport of the guest", "travel document", "PASSPORT"],
    "citizen": ["national ID", "National ID number", "ID-card", "identity number", "identity no.", "Personalausweis", "Ausweisnummer", "DNI", "NIE", "carte d'identité", "documento de identidad", "personal number", "Aadhaar", "citizen ID", "resident number", "INSEE", "numéro de sécurité sociale", "social insurance number"],
}
# Digits #, any letter L, letters of a check sign Z; formats of public number schemes.
IDS = {
    "ssn": ["###-##-####", "### ## ####", "#########", "9##-##-####"],
    "tax": ["## ### ### ###", "###########", "##/###/#####", "###/####/####", "##-#######", "### ### ###", "L#######Z", "###/###/#####", "########Z", "## #########"],
    "ni": ["LL ## ## ## Z", "LL######Z", "LL######", "LL ## ## ## L", "L#########", "## ###### Z ###", "QQ ## ## ## Z", "QQ######Z"],
    "passport": ["L########", "LL#######", "#########", "L#######", "##LL#####", "LL######", "LLL######"],
    "citizen": ["########Z", "########-Z", "L#######Z", "#### #### ####", "############", "######-####", "######-#####", "# ## ## ## ### ### ##", "### ### ###", "L##########", "###.###.###-##", "######/####", "L########", "LL#######"],
}
PHONES = ["+1 ### ### ####", "+1-###-###-####", "(###) ###-####", "###-###-####", "###.###.####", "1-###-###-####", "+1##########", "### ### ####", "1 ### ### ####", "+1 (###) ###-####", "###‑###‑####", "###–###–####", "+44 20 #### ####", "+44 7### ######", "020 #### ####", "07### ######", "07### ### ###", "(01##) ### ####", "+44 (0)1## ### ####", "+44 7### ### ###", "+49 ### #######", "+49 (0)## #######", "0## / #######", "0###/######", "0##-########", "+49-##-#####-##", "+49 ## ##### ###", "0##/#####-###", "+33 # ## ## ## ##", "0# ## ## ## ##", "0#.##.##.##.##", "0033 # ## ## ## ##", "+33-#-##-##-##-##", "0033-#-####-####", "+34 ### ### ###", "+34 ### ## ## ##", "9## ### ###", "+34#########", "6## ## ## ##", "+61 4## ### ###", "04## ### ###", "(0#) #### ####", "+61 # #### ####", "+39 0# #######", "+31 6 ########", "+41 ## ### ## ##", "+91 ##### #####", "+81 3-####-####", "+55 ## #####-####", "+48 ### ### ###", "+46 ##-### ## ##", "+353 ## ### ####", "00## ### ######", "+## ### #######", "+############", "0800 ######", "1-800-###-####"]

# Contexts that look alike. Beside the small letters above: {h} host, {g} a given name, {C} a capitalised common word,
# {q} digits in a form of phones or identity numbers, {x} hex digits, {s} an id or path of code, {z} a capitalised pair.
EMPTY = [x.replace("\\n", "\n") for x in r"""{f}
{f} {f}
- {f}
the {n} {v}s the {n}
git remote add origin git@{h}:{n}/{n}.git
git push ssh://git@{h}:{0}/{n}
url = https://{n}:{x}@{h}/{n}.git
postgres://{n}:{n}@{h}:5432/{n}
amqp://{u}@{h}//
scp {n}.tar {n}@{h}:/srv/{n}
rsync -a {u}@{h}:{n} .
npm install @{n}/{n}@{0}.{0}.{0}
pip install "{n} @ https://{h}/{n}.whl"
{n}@{0}.{0}.{0} replaces {n}@{0}.{0}
@{n}.setter
@{n}
@pytest.mark.{n}
y = {n} @ {n}.T + b
{n} = {n}@{n}.T
{s} = {n}@w.T @ x
z = q@{n}.mean(0)
use {n}@{0}.{0} or {n}@{0}.{0}.{0}
{n}{n}@{0}.{0}.{0}, {n}-{n}@{0}.{0}.{0}
needs {C}@{0}.{0}
@{n}({n}={0})
@{u} @{u}
({0}0{0}-0{0}-1{0})
20{0}-0{0}-1{0}: {f}
{0}.{0}.{0} (20{0}-1{0}-0{0})
commit {q}
hash {q} or {x}
revision {x}{x}
at {x} it {v}s
call {n} or {v} {n} first
{C} {n} and {n} {C}
{C}: {C} {n}
On {C} {C} {f}
In {C} the {C} {v}s
thanks @{u} and @{u}
cc @{u}
ping @{u}-{u} please
{u} {v}s the {n} at {0}:{0}
user @{u}{0} asked
meet at the {n} dot {n}
look at {n} dot {n}
{g} {C} is the new {n}.
{g} {C} {v}s the {n}
the {g} {C} {n}
{g} {C} and {g} {C} are {n} names
{g} {C} and {C} {C}
enable {g} {C} in the settings
{g} {C} is now the default, {g} {C} is removed.
{g} {C} ships with version {0}.
{g} is a code name
{g} {v}s it
{z}
# {z}
## {z} {C}
{z}: {f}
The {z} {n} is new.
See {z}.
{z} and {z}
{z} is enabled, {z} is not.
we use {z} for the {n}
| {z} | {C} | {0} |
Contacts: none
Author: none
Name:
Address: 0x{x}
address {x}:{0}
phone: none
Off the {n}: {f}
{C} {C}, {C} {C}
{w}, {0} {w} 20{0}
{0} {w} 20{0}
20{0}-0{0}-{0} {0}:{0}:{0}
[20{0}/{0}/{0} {0}:{0}]
order {q} was shipped
order number {q}
order no. {q} for the {n}
invoice {q}, due {w}
ticket {q}
ticket number {q} is closed
case {q} is a duplicate of {q}
build {q}
build no. {q} failed on {w}
job {q} finished
run {q} took {0} s
serial {q}
tracking {q}
part number {q}
checksum {q}
error code {q}
bug {q}, bug {q}
id={q}
{n}_id: {q}
row {q}
the {n} id {q} is not a person's
issue #{q}
PR {q}
version {q}
session {q}
sku {q}
ISBN 978-{0}-{q}
build {x}
commit {x} {v}s the {n}
sha256:{x}{x}{x}
uuid {x}-{x}-{x}
0x{x}
port {0}{0}
ports {0}-{0} and {0}{0}-{0}{0}
192.168.{0}.{0}:{0}
10.0.{0}.{0}/{0}
lines {0}-{0}{0}
rows {0}{0} to {0}{0}
pages {0}-{0}, {0}
{0},{0}{0}0 {n}s
{0} {C} {C}, {0} {n}s
{0} {n}s, {0}{0} {n}s, {0} {C}s
{0} {C} {n}
from {0} to {0} {C} {C}
took {0}{0} ms and {0}{0} ms
{0}.{0}.{0}
{0}/{0}/{0}
{0}% of {0}{0} {n}s
mtime {0}{0}{0}{0}{0}
1{q}{0} ns
x = [{0}, {0}{0}, {0}]
({0}, {0}) ({0}, {0})
{s}
`{s}` {v}s `{s}`
{s} -> {s}
see {s}, line {0}
class {C}{C}({C}):
def {v}_{n}(self, {n}):
{v}_{n} and {v}_{n} {v} it
const {n} = new {C}{C}()
import {C}{C} from "./{n}"
{{"ok": true, "{n}": {0}, "{n}": "{s}"}}
{{"{n}_id": {q}, "{n}": "{C} {C}"}}
<{n} {n}="{0}">{C} {C}</{n}>
Der {C} ist leer, die {C} nicht.
Die {C} {C} wird geladen.
Le {n} ne marche pas.
La {n} está vacía.
Ticket {q} ist erledigt.
la commande {q} est annulée
el pedido {q} está cerrado
| {n} | {n} | {0} |
> {f}
{z}, {z}, {z}
{C}-{C} and {C}{C}
{C} {C} v{0}
{C} of {C}
{C} & {C}
By {C} or by {C}
By {C} {C} first
by {n} and {n}
reviewed by the {n} team
approved by {C}
thanks to the {C} {n}
ask the {C} {n}""".split("\n")]

# Other languages, without personal information.
FOREIGN = """Der {C} läuft seit {0} Tagen ohne Fehler.
Die {C} hat {0}{0} Zeilen, {0} sind leer.
Die {C} prüft {0} {C}, {0} fehlen noch.
Das {C} fehlt im {C} und in der {C}.
Im {C} steht ein {C} zu viel.
Am {w} wird die {C} neu gebaut.
Wir haben das {C} in der {C} geändert.
Können wir die {C} bitte löschen?
Ohne {C} gibt es keine {C}.
Beim {C} dauert die {C} {0} Sekunden.
Alle {C} und {C} sind jetzt im {C}.
Eine {C} je {C} reicht.
Nach dem {C} ist der {C} weg.
Zwei {C} in einem {C}, bitte trennen.
La {n} prend {0} secondes au lieu de {0}.
Le {n} ne lit plus les {0} fichiers.
Les {n} sont vides depuis {w}.
Pourquoi la {n} est-elle si lente ?
Il faut relancer {n} après chaque {n}.
Une {n} de {0}{0} lignes manque encore.
On ne trouve plus le {n} dans la {n}.
Cette {n} n'est pas utilisée, {0} tests échouent.
Aucun {n} ne correspond, {0} au total.
El {n} tarda {0} segundos en leer la {n}.
La {n} tiene {0}{0} filas y {0} errores.
Los {n} se guardan en el {n} cada {w}.
No se puede borrar la {n} sin el {n}.
Hay que volver a leer {n} y {n}.
¿Por qué el {n} devuelve una lista vacía?
Faltan {0} pruebas para el {n}.
Il {n} non legge la {n}.
De {n} is leeg, de {n} niet.""".split("\n")


def _digits(r: random.Random, form: str) -> str:
    return "".join(str(r.randint(0, 9)) if c == "#" else c for c in form)


_ON = "b c d f g h j k l m n p r s t v w z br ch cl cr dr fl fr gr kl kr pl qu sch sh st str th tr wh".split()
_VOWEL = "a e i o u a e i o a e ai au ea ee ei ie oa oo ou y".split()
_OFF = ["", "", "", "", "l", "n", "r", "s", "t", "m", "ck", "ll", "nd", "ng", "rd", "rn", "rt", "sk", "ss", "st", "th", "tt", "x", "z", "ld", "lm", "rk"]
_ACCENT = {"a": "áàäâãå", "e": "éèëê", "i": "íîï", "o": "óöôõø", "u": "úüû", "n": "ñń", "c": "çč", "s": "šś", "z": "žż", "l": "ł"}
_KIN = ["son", "sen", "berg", "stein", "man", "mann", "ova", "ov", "ski", "ska", "wicz", "ez", "ini", "elli", "etti", "eau", "ault", "er", "ler", "feld", "bach", "burn", "ford", "ham", "ley", "ton", "well", "wood", "worth", "by", "strand", "qvist", "gren", "ides", "opoulos", "yan", "shvili", "enko", "oglu", "ura", "moto", "nath", "kar", "dale", "field", "stone", "more", "croft", "lock", "horn", "low", "mead", "feather", "gate"]
# Parts of surnames that are made of words.
_STEM = "ash beech birch black bright brook clear cold cross dark deep dun east elder fair far fern fox gold grand great green hart haw hay high hol ken lang lin long lower mar mead mid moor new nor north oak old over pen pine red ridge rose rush sand sharp shep silver south spring stan stone strong summer swan sweet tar thorn under up wal water way well west wheat wild win wind winter wood york bank barn berry carr drift feld hal kettle land lock mill pel quick rather sel tan ven whit".split()
_END = "wold rick dene gate ley bury thwaite wick stead worth man combe sher mere cliff den don over ridge burn brook bank side house wright smith herd grove hurst shaw ward water well mont bert win land hill ham lake low lund rake ray path vane tree fast good hall kirk pole scough leigh acre".split()
_TOWN = ["ton", "ham", "by", "ford", "bury", "ville", "field", "stead", "mouth", "port", "haven", "burg", "heim", "stadt", "au", "dorf", "hausen", "ac", "court", "mer", "igny", "ar", "era", "ales", "", "wick", "minster", "gate", "pool", "mere", "bridge", "felden"]


def _word(r: random.Random, parts: tuple[int, int] = (1, 3)) -> str:
    on = lambda: r.choice(_ON) if r.random() < 0.3 else r.choice("bcdfghjklmnprstvwz")
    return "".join(on() + (r.choice(_VOWEL) if r.random() < 0.3 else r.choice("aeiou")) + (r.choice(_OFF) if r.random() < 0.45 else "") for _ in range(r.randint(*parts)))


def _accented(r: random.Random, w: str) -> str:
    at = [i for i, c in enumerate(w) if c in _ACCENT]
    if not at:
        return w
    i = r.choice(at)
    return w[:i] + r.choice(_ACCENT[w[i]]) + w[i + 1 :]


def given(r: random.Random) -> str:
    k = r.random()
    if k < 0.5:
        return r.choice(GIVEN)
    w = _word(r, (1, 2)) + r.choice(["", "a", "o", "e", "ina", "us", "ie", "an", "ette", "in", "ya", "wen"])
    if r.random() < 0.15:
        w = _accented(r, w)
    return w.capitalize()[:11]


def family(r: random.Random) -> str:
    k = r.random()
    if k < 0.38:
        f = r.choice(FAMILY)
    elif k < 0.6:
        f = (r.choice(_STEM) + r.choice(_END if r.random() < 0.7 else _KIN)).capitalize()
    else:
        w = _word(r, (1, 2)) + (r.choice(_KIN) if r.random() < 0.7 else r.choice(["", "a", "o", "er"]))
        f = (_accented(r, w) if r.random() < 0.15 else w).capitalize()
    if r.random() < 0.06:
        f += "-" + (r.choice(FAMILY) if r.random() < 0.5 else _word(r).capitalize())
    k = r.random()
    if k < 0.035:
        f = r.choice(["Mac", "Mc", "O'", "O’", "D'", "Al-", "El-", "St. "]) + f
    elif k < 0.085:
        f = r.choice(PARTICLES) + " " + f
    return f


def name(r: random.Random, small: bool = True) -> str:
    """A person's name; in small letters only where ``small`` allows."""
    g, f, k = given(r), family(r), r.random()
    initial = lambda: r.choice("ABCDEFGHIJKLMNOPRSTVWYZ")
    if k < 0.6:
        s = f"{g} {f}"
    elif k < 0.72:
        s = f"{g} {initial()}. {f}"
    elif k < 0.82:
        s = f"{initial()}. {f}"
    elif k < 0.85:
        s = f"{initial()}. {initial()}. {f}" if r.random() < 0.5 else f"{initial()} {f}" if r.random() < 0.2 else f"{initial()}.{initial()}. {f}"
    elif k < 0.94:
        s = f"{f}, {g}" if r.random() < 0.85 else f"{f}, {initial()}."
    elif k < 0.97:
        s = f"{g} {given(r)} {f}"
    else:
        s = f"{g} {f} {family(r)}"
    k = r.random()
    s = s.upper() if k < 0.06 else s.lower() if k < 0.15 and small else s
    return s.replace(" ", r.choice(["\n", "\n  ", "  "]), 1) if r.random() < 0.03 else s


def _plain(s: str) -> str:
    return "".join(c for c in s.lower() if c.isascii() and c.isalnum())


def account(r: random.Random) -> str:
    a = r.choice([*NOUNS, *VERBS]) if r.random() < 0.5 else _plain(given(r))
    return a + r.choice(["", "", str(r.randint(1, 99)), "-" + r.choice(NOUNS), "_" + r.choice(VERBS), r.choice(NOUNS)])


def domain(r: random.Random) -> str:
    w = lambda: r.choice(NOUNS) if r.random() < 0.3 else _word(r, (1, 2))
    d = w() + r.choice(["", "", "-" + w(), w(), "." + w()])
    return f"{r.choice(['', '', '', 'mail.', 'dev.', 'lists.'])}{d}.{r.choice(TLDS)}"


def email(r: random.Random) -> str:
    g, f = _plain(given(r)) or "x", _plain(family(r)) or "y"
    n = str(r.randint(1, 99))
    local = r.choice([f"{g}.{f}", f"{f}.{g}", f"{g[0]}{f}", f"{g[0]}.{f}", f"{g}-{f}", f"{g}_{f}", f"{g}{f}", f"{g}_{f}{n}", f"{f}{r.randint(1955, 2010)}", f"{f}{n}", f"{g}+{r.choice(NOUNS)}", f"{g}.{f}+{r.choice(NOUNS)}", f"{g}.{f}{n}", g, f, f"{g}%{f}", r.choice(["info", "office", "contact", "help", "sales", "hr"]), account(r)])
    d, k = domain(r), r.random()
    if k < 0.66:
        s = f"{local}@{d}"
    else:
        at = r.choice([" at ", " AT ", "(at)", " (at) ", "[at]", " [at] ", "{at}", " {at} ", " @ ", "(@)", " [AT] "])
        dot = "." if r.random() < 0.45 or at == " @ " else r.choice([" dot ", " DOT ", "(dot)", " [dot] ", "[dot]", "{dot}", " (dot) ", " {dot} "])
        s = local + at + d.replace(".", dot)
    k = r.random()
    return s.title() if k < 0.05 else s.upper() if k < 0.09 else s


def phone(r: random.Random) -> str:
    s = _digits(r, r.choice(PHONES))
    if r.random() < 0.12:
        s = s.replace(" ", r.choice([" ", " ", "‑", "-", ".", "/"]))
    if r.random() < 0.03 and " " in s:
        s = s.replace(" ", "\n", 1)
    return s


def identity(r: random.Random, kind: str) -> str:
    s = _digits(r, r.choice(IDS[kind]))
    letters = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    s = "".join(r.choice(letters) if c == "L" else r.choice("ABCDEFGHJKLMNPRSTVWXYZ") if c == "Z" else c for c in s)
    return s.replace(" ", "\n", 1) if r.random() < 0.01 else s


def _cap(r: random.Random) -> str:
    k = r.random()
    return r.choice(NOUNS).capitalize() if k < 0.3 else r.choice(FAMILY) if k < 0.45 else _word(r, (1, 2)).capitalize()


def town(r: random.Random) -> str:
    t = (_word(r, (1, 2)) + r.choice(_TOWN)).capitalize()
    if r.random() < 0.1:
        t = _accented(r, t)
    return r.choice(["New ", "St. ", "Bad ", "Saint-", "San ", "Upper ", "Port "]) + t if r.random() < 0.12 else t


def address(r: random.Random) -> str:
    k, br = r.random(), r.choice(["\n", "\n  ", "\n    "]) if r.random() < 0.28 else None
    no = str(r.randint(1, 260)) if r.random() < 0.9 else str(r.randint(1, 9999))
    if k < 0.5:
        street = _cap(r) + (" " + _cap(r) if r.random() < 0.15 else "")
        flat = r.choice(["", "", "", f"Flat {r.randint(1, 40)}, ", f"Apt {r.randint(1, 90)}, ", f"Apt. {r.randint(1, 9)}{r.choice('ABCD')}, ", f"Unit {r.randint(1, 30)}, ", f"Suite {r.randint(100, 900)}, ", f"Flat {r.randint(1, 9)}{r.choice('ABCD')}, ", f"Room {r.randint(1, 500)}, "])
        state = r.choice(["", "", r.choice(["NY", "CA", "TX", "OR", "WA", "MA"])])
        code = r.choice([_digits(r, "#####"), _digits(r, "#####"), _digits(r, "#####-####"), "", "", "".join(r.choice("BCDEGHLMNRSTW") if c == "L" else str(r.randint(0, 9)) if c == "#" else c for c in r.choice(["LL# #LL", "LL## #LL", "L# #LL", "LL#L #LL"])), _digits(r, "####")])
        tail = f" {state}" * bool(state) + (r.choice([" ", ", ", " "]) + code if code else "")
        way = r.choice(WAYS)
        house = f"{no}{r.choice(['', '', '', 'a', 'B'])}"
        return f"{flat}{house} {street} {way}{br or r.choice([', ', ', ', ', ', ' '])}{town(r)}{tail}"
    if k < 0.7:
        w = _cap(r)
        way = r.choice(DE_WAYS)
        street = w + way if not way.startswith(" ") or r.random() < 0.5 else r.choice(["Alte", "Neue", "Lange", "Am", "An der"]) + " " + w + way.strip()
        return f"{street} {no}{r.choice(['', '', '', 'a', ' b'])}{br or r.choice([', ', ', ', ' '])}{r.choice(['', '', 'D-', 'A-', 'CH-'])}{_digits(r, r.choice(['#####', '#####', '####']))} {town(r)}"
    if k < 0.86:
        of = r.choice(["de la ", "du ", "des ", "de ", "de l'", "", "Saint-"])
        thing = _cap(r) + ("-" + _cap(r) if r.random() < 0.2 else "") + r.choice(["", "s", "e"])
        return f"{no}{r.choice(['', '', ' bis', ' ter'])}{r.choice([', ', ' '])}{r.choice(FR_WAYS)} {of}{thing}{br or r.choice([', ', ' - ', ' – '])}{_digits(r, '#####')} {town(r)}"
    of = r.choice(["", "de ", "de la ", "del ", "de las ", "de los ", "Mayor "])
    return f"{r.choice(ES_WAYS)} {of}{_cap(r)}{r.choice([' ', ', ', ' nº '])}{no}{r.choice(['', '', ', 2º B', ' bajo'])}{br or ', '}{_digits(r, '#####')} {town(r)}"


_SLOT = re.compile(r"\{([A-Za-z0])\}|\{\{|\}\}")


class Source:
    """Text of a seed: contexts, look-alikes and background lines (any text without personal information). ``contexts``, if
    there are any, are [text, kind, text, ..., text] with a letter of a kind, as in HOLDING, at each place of a value."""

    def __init__(self, seed: int, background: list[str], contexts: list[list[str]] = ()):
        self.r, self.background, self.contexts = random.Random(seed), background, contexts
        self.words = sorted({w for line in background for w in re.findall(r"\b[a-z]{3,12}\b", line)}) or NOUNS

    def _capital(self) -> str:
        return self.r.choice(self.words if self.r.random() < 0.6 else NOUNS).capitalize()

    def _code(self) -> str:
        r = self.r
        n = lambda: r.choice(NOUNS)
        return r.choice([f"{n()}.{n()}.{r.choice(VERBS)}_{n()}", f"{n()}/{n()}/{n()}.py", f"{n()}://{n()}.{n()}:{self._capital()}{self._capital()}.{r.choice(VERBS)}", f"{self._capital()}{self._capital()}", f"{n()}::{r.choice(VERBS)}({n()})", f"{n().upper()}_{n().upper()}"])

    def _filler(self) -> str:
        r = self.r
        if r.random() < 0.5:
            return r.choice(self.background) if self.background else "It works."
        if r.random() < 0.5:
            form = r.choice(FOREIGN)
            return _SLOT.sub(lambda m: self._fill(m[1]) if m[1] else m[0][0], form)
        return r.choice(["We {v} the {n} and {v} the {n}.", "the {n} must {v} it first", "It does not {v} the {n} any more.", "Why does the {n} {v} twice?", "this {v}s every {n}", "no {n}, no {n}"]).format(v=r.choice(VERBS), n=r.choice(NOUNS))

    def _fill(self, c: str) -> str:
        r = self.r
        if c == "f":
            return self._filler()
        if c == "C":
            return self._capital()
        if c == "s":
            return self._code()
        if c == "z":
            return " ".join(self._capital() for _ in range(2))
        if c == "q":
            k = r.random()
            return phone(r) if k < 0.35 else identity(r, r.choice(list(IDS))) if k < 0.75 else str(r.randint(10**6, 10**12))
        if c == "x":
            return "".join(r.choice("0123456789abcdef" if r.random() < 0.8 else "0123456789") for _ in range(r.randint(4, 12)))
        if c == "0":
            return str(r.randint(0, 99))
        if c == "h":
            return domain(r)
        if c == "g":
            return given(r)
        if c == "u":
            return account(r)
        return r.choice({"n": NOUNS, "v": VERBS, "d": DONE, "y": SAYS, "k": ASKS, "r": ROLES, "t": TITLES, "w": DAYS}[c])

    def holding(self) -> tuple[str, list[tuple[int, int, int]]]:
        """A context with its values, and their (start, end, kind)."""
        r = self.r
        k = r.random()
        if k < 0.4:
            return self._anywhere()
        if k < 0.6 and self.contexts:
            parts = r.choice(self.contexts)
        else:
            parts, form, at = [""], r.choice(HOLDING), 0
            for m in _SLOT.finditer(form):
                parts[-1] += form[at : m.start()] + ("" if m[1] else m[0][0])
                parts += [m[1], ""] if m[1] else []
                at = m.end()
            parts[-1] += form[at:]
        out, spans = parts[0], []
        kind_of_id = r.choice(list(IDS))
        for c, text in zip(parts[1::2], parts[2::2]):
            if c in "EPIAN":
                kind, value = {"E": (0, email), "P": (1, phone), "I": (2, lambda r: identity(r, kind_of_id)), "A": (3, address), "N": (4, name)}[c]
                v = value(r)
                spans.append((len(out), len(out) + len(v), kind))
                out += v
            else:
                out += r.choice(LABELS[kind_of_id]) if c == "K" else self._fill(c)
            out += text
        if spans and spans[0][0] > 0 and out[0].islower() and r.random() < 0.5:
            out = out[0].upper() + out[1:]
        return out, spans

    def _some(self, most: int) -> str:
        """Up to ``most`` words and signs in no order that means anything."""
        r = self.r
        out = [r.choice(self.words) if r.random() < 0.6 else r.choice([*NOUNS, *VERBS, *DONE, "by", "to", "of", "for", "with", "and", "from", "is", "the", "a", "on", "in", "at", "as", "I", "we", "no", "cc", "re", "von", "an", "bei", "de", "par", "con", "per"]) for _ in range(r.randint(0, most))]
        s = " ".join(out)
        if s and r.random() < 0.4:
            s = s[0].upper() + s[1:]
        return s

    def _anywhere(self) -> tuple[str, list[tuple[int, int, int]]]:
        """One to three values among words that say nothing of them; an identity number has its label near."""
        r = self.r
        out, spans = self._some(5), []
        for i in range(r.choice([1, 1, 1, 2, 2, 3])):
            out += r.choice(["", " ", " ", " ", " ", ": ", ", ", " - ", " (", "; ", " / ", " | ", "\n", "\n  ", "\n\n", ' "', " = ", "\t"]) if out or i else ""
            k, label = r.choice([0, 1, 2, 3, 4, 4, 4]), ""
            if k == 2:
                form = r.choice(list(IDS))
                v, label = identity(r, form), r.choice(LABELS[form])
                if r.random() < 0.6:
                    out += label + r.choice([" ", ": ", " = ", " " + self._some(2) + " ", " no. ", " is ", "=", " (", "\n"])
                    label = ""
            else:
                v = address(r) if k == 3 else email(r) if k == 0 else phone(r) if k == 1 else name(r, small=False)
            if out and out[-1].isalnum():
                out += " "
            spans.append((len(out), len(out) + len(v), k))
            out += v
            if label:
                out += r.choice([" ", " (", ", ", ": ", " is the ", ", " + self._some(3) + " "]) + label
        tail = self._some(5)
        return out + r.choice([" ", " ", ", ", ". ", "; ", ": ", "'s " if spans[-1][2] == 4 else " ", ") ", "\n", " - ", '" ', "? ", "! "]) * bool(tail) + tail, spans

    def empty(self) -> str:
        form = self.r.choice(EMPTY)
        if self.r.random() < 0.25:
            form = f"{self._some(5)} {self.r.choice(['{z}', '{z}', '{g} {C}', '{C} {n} {C}', '{0}{0}-{0}{0}', '{x}', '{n}@{0}.{0}', '@{u}', '{s}', '{0}.{0}.{0}', '{C}, {C}', '{C}'])} {self._some(5)}"
        s = _SLOT.sub(lambda m: self._fill(m[1]) if m[1] else m[0][0], form)
        return s.upper() if self.r.random() < 0.02 else s

    def stream(self, size: int, rare: float = 1.0) -> tuple[str, list[tuple[int, int, int]]]:
        """About ``size`` characters in random order, and all spans; ``rare`` below 1 makes contexts rarer."""
        r = self.r
        parts, spans, n = [], [], 0
        broken = False  # whether the lines of the present text end in two signs
        while n < size:
            k = r.random()
            own: list = []
            if k < 0.42 * rare:
                s, own = self.holding()
            elif k < 0.42 * rare + 0.33:
                s = self.empty()
            else:
                s = r.choice(self.background) if self.background else self._filler()
            if r.random() < 0.12:
                lead = r.choice(["- ", "* ", "user: ", "    ", "# ", "// ", "> ", "+ ", "1) ", "note: ", '"', "("])
                s, own = lead + s, [(a + len(lead), b + len(lead), c) for a, b, c in own]
            if broken:
                s, own = s.replace("\n", "\r\n"), [(a + s.count("\n", 0, a), b + s.count("\n", 0, b), c) for a, b, c in own]
            spans += [(a + n, b + n, c) for a, b, c in own]
            end = r.choice(["\n", "\n", "\n\n", "\n\n", " ", " ", "\r\n", ". ", "; ", "\0" * 24, "\n" + "\0" * 24])  # the gap between texts
            if "\0" in end:
                broken = r.random() < 0.15
            if broken and "\r" not in end:
                end = end.replace("\n", "\r\n")
            parts.append(s + end)
            n += len(s) + len(end)
        return "".join(parts), spans
