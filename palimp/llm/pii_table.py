"""The labelled table that the personal-information model is trained from.

Each row is a passage of one or more sentences with marked spans. Sentences come
from a small grammar over everyday subjects (housing, school, clinic, club,
post, shop): carriers with slots, and person, thing and place phrases that are
combined by rule. Most names are built from syllables, so that hardly one comes
twice and the model has to go by shape and context; so are brands, firms and
products, which stand in the sentences without personal information. Numbers
follow the public formats of a dozen countries, and beside each stand other
numbers of the same look. Disturbances (capitals, exchanged and inserted words,
doubled blanks, wrong encodings) are added to a part of the rows.
"""

from __future__ import annotations

import random
import re

KINDS = ("email", "phone", "id_number", "address", "name")

# Given names, by the script they are written in.
GIVEN = """Michael Jennifer Linda Robert Susan Kevin Margaret Siobhan Declan Gwen Rhys Alasdair Kwame Abena Chidi Zanele Thabo Imani Wolfgang Amadeus Heike Jürgen Ulrike Detlef Sabine Katrin
Lena Mathilde Benoît Élodie Gaëlle Thierry Solène Hélène Guillaume Chloé Alejandro Lucía Íñigo Begoña Rocío Javier Pilar Guadalupe Matteo Chiara Lorenzo Ginevra Raffaele Francesca Tiago Inês
Gonçalo Beatriz Agnieszka Krzysztof Małgorzata Paweł Wojciech Jadwiga Søren Freja Åsa Linnéa Mikko Aino Jari Eszter Zoltán Ilona Bogdan Ioana Vasile Milena Goran Jelena Eleni Kostas Despina
Mehmet Ayşe Emre Elif Omar Layla Yusuf Khadija Tariq Zainab Arjun Lakshmi Vikram Sunita Rajesh Deepa Ananya Minh Linh Tuan Haruto Sakura Kenji Naoko Jisoo Minjun Xiaoming Lihua Wei Jun""".split()
CYRILLIC_GIVEN = "Наталья Владимир Юлия Алексей Татьяна Виктор Людмила Константин Галина Михаил Светлана Григорий Вера Роман Полина Кирилл Лариса Фёдор Тамара Степан".split()
PATRONYMIC = ("Петро", "Ивано", "Сергее", "Алексее", "Никола", "Михайло", "Андрее", "Викторо")
# Syllables that family names, brands and places are built from.
ONSETS = "b br c cl d dr f fl g gr h j k kr l m n p pr r s sch st t tr v w z sh th ch gl pl bl sp".split()
VOWELS = "a e i o u a e o ai ei ou ie au".split()
CODAS = "n r l s t m nd rt ck ll ng rg ss x lt rn".split()
FAMILY_ENDS = "er son man ini ez ski ska sen mann berg ard eau escu ova ov enko idis oglu dottir aki moto yama ero as es inen ius aite ley ton field ham wood well worth shaw brook cott den kamp hofer bauer huber lin ley by ford ster".split()
FAMILY = """Smith Jones Taylor Brown Murphy Kelly Byrne Campbell Evans Morgan Okafor Mensah Nkrumah Dlamini Abubakar Schneider Krause Fischer Becker Hofmann Zimmermann Vogt Dubois Lefèvre Moreau Girard Fournier García
Fernández Ruiz Navarro Ortega Rossi Bianchi Ferrari Esposito Colombo Silva Pereira Almeida Kowalski Nowak Wiśniewska Lewandowski Hansen Nielsen Lindqvist Johansson Virtanen Korhonen Nagy Szabó Popescu Jovanović Papadopoulos
Yılmaz Demir Haddad Mansour Sharma Patel Gupta Iyer Nguyen Tran Tanaka Suzuki Watanabe Kim Park Zhang Wang Liu""".split()
CYRILLIC_FAMILY = "Смирн Кузнец Попо Соколо Лебеде Новико Морозо Волко Зайце Павло Голубе Виноградо Беляе Тарасо Комаро Орло Киселе Андрее Макаро Захаро Ершо Пономаре Судако Глухаре Бобро".split()
HAN_FAMILY = "山田 佐藤 鈴木 高橋 田中 伊藤 渡辺 中村 小林 加藤 吉田 山口 松本 井上 木村 清水 斎藤 藤田 岡田 長谷川".split()
HAN_GIVEN = "太郎 花子 一郎 健太 美咲 陽子 直樹 真由美 翔 恵子 大輔 由紀 拓也 さくら 誠".split()
TITLES = "Mr Mrs Ms Miss Dr Prof Sir Mr. Mrs. Ms. Dr. Prof. Frau Herr Herrn Mme M. Mlle Sr. Sra. Sig. Sig.ra Señor Doña Pan Pani Dhr. Rev. Sister".split()

# Words of addresses.
ROADS = "Street Road Lane Avenue Drive Close Way Terrace Crescent Grove Place Square Hill Row Gardens St. Rd. Ave. Dr. Ln. Blvd. Mews Walk Parade".split()
HOUSES = "Court House Lodge Mansions Buildings Tower Heights".split()
ROAD_NAMES = """Elm Oak Cedar Willow Juniper Birch Chestnut Bramble Heather Primrose Victoria Albert King's Queen's Park Mill Bridge Castle Abbey Priory Market Harbour Riverside Lakeview Sunset Hillcrest Meadow Spring Garden
Kingfisher Nightingale Falcon Swan Pheasant Badger Foxhill Ashdown Lincoln Washington Jefferson Franklin Madison""".split()
GERMAN_ROADS = "Goethe Schiller Garten Wald Wiesen Schul Berg Ring Markt Rosen Tannen Blumen Mozart Beethoven Feld Brunnen Kastanien Ulmen Nelken Post".split()
GERMAN_ENDS = "straße weg gasse allee platz str. ufer damm ring".split()
GERMAN_PHRASES = ["Am Stadtpark", "An der Kirche", "Auf dem Hügel", "Im Winkel", "Zum Sportplatz", "Unter den Eichen", "Am Wasserturm", "In der Aue"]
FRENCH_ROADS = "de la République,Victor Hugo,des Tilleuls,du Château,des Écoles,de Verdun,du Marché,des Peupliers,de l’Hôtel de Ville,Pasteur,du Lavoir,des Acacias,de la Fontaine,aux Herbes,du Pont-Neuf,des Petits-Champs".split(",")
SPANISH_ROADS = "Mayor,del Sol,de la Paz,San Juan,Cervantes,de los Olivos,Real,del Carmen,de Goya".split(",")
ITALIAN_ROADS = "Roma,Garibaldi,Dante Alighieri,Verdi,delle Rose,San Martino,Mazzini,dei Mille".split(",")
RUSSIAN_ROADS = "Ленина,Пушкина,Садовая,Гагарина,Лесная,Чехова,Советская,Мира,Набережная,Школьная".split(",")
RUSSIAN_TOWNS = "Тверь,Казань,Самара,Псков,Омск,Рязань,Пермь,Тула".split(",")
POLISH_ROADS = "Długa,Lipowa,Kościuszki,Polna,Mickiewicza,Słoneczna".split(",")
JAPANESE_TOWNS = "東京都千代田区丸の内 大阪市北区梅田 京都市左京区吉田 横浜市中区山下町 札幌市中央区大通 名古屋市東区泉".split()
TOWN_ENDS = "ford ton bury ham ville stadt heim dorf burg field port mouth by wick brück hausen ac igny ona ello ów".split()

# Words that take part in sentences without being personal.
ROLES = """caretaker,librarian,head teacher,receptionist,accountant,night nurse,bus driver,gardener,landlord,treasurer,cook,electrician,ticket inspector,lifeguard,head of department,deputy manager,board member,lab assistant,
shop assistant,project lead,trainee,night porter,cleaner,plumber,duty officer,team leader,inspector,clerk,editor,umpire""".replace("\n", "").split(",")
DEVICES = """kettle,lawn mower,boiler,photocopier,projector,ladder,printer,pump,oven,generator,scanner,dishwasher,trailer,heater,camera,router,compressor,piano,tractor,bicycle,microscope,mixer,sewing machine,forklift,
hand dryer,lift motor,water filter,ice maker""".replace("\n", "").split(",")
THINGS = """invoice,parcel,key ring,lease,radiator,timetable,library card,school report,ticket,receipt,fence,cupboard,prescription,menu,match sheet,song book,appointment,delivery note,blue folder,spare key,meter reading,garage door,
registration form,seat cushion,roof tile,window frame,notice board,lunch box,order book,rent deposit""".replace("\n", "").split(",")
DEEDS = "repaired lost returned paid cancelled painted delivered signed opened cleaned copied renewed moved replaced booked stamped refused collected stored filed checked tested counted".split()
TIMES = """this morning,last week,before noon,after the holidays,on Friday,at the front desk,without notice,by post,in the second term,at half past three,every other month,since March,until further notice,in the new building,next to the gate,
twice a year,during the break,behind the counter,on the ground floor,in good order""".replace("\n", "").split(",")
FIRM_ENDS = "Ltd,Inc.,GmbH,AG,S.A.,& Sons,Brothers,Plumbing,Foods,Motors,Printing,Insurance,Textiles,Systems,Garden Centre,Bakery,Logistics,Glassworks,Publishing,Energy,Oy,SpA,sp. z o.o.,Holdings,Chemie,Optics".split(",")
BODIES = """Parents' Council,Planning Committee,Tenants' Association,Works Council,Town Library,Finance Department,Night Shift,Front Office,Housing Board,Swimming Club,Data Protection Office,Central Station,Customer Service,
Accounts Payable,Head Office,Court of Appeal,City Archive,Health Department,Safety Committee,Chess Club""".replace("\n", "").split(",")
TRADES = "Contractor Dealer Manufacturer Importer Distributor Supplier Producer Hotel School Restaurant Bakery Garage Agency Vendor Carrier Publisher Landlord Client Customer Company".split()
ORDERS = """Lift Pour Insert Carry Remove Turn Press Hold Close Open Push Pull Fill Empty Shake Cut Fold Wrap Load Unload Count Mark Sort Stack Sweep Wipe Dry Heat Cool Mix Stir Grind Melt Measure Note Draw Print Copy Clip Tie Lock
Unlock Switch Plug Charge Reset Adjust Tighten Loosen Attach Replace Return Order Pay Bring Take Put Leave Wait Repeat Stop Start Avoid Use Ensure Apply Enter Select Verify Report Never Always When While After Before Until Since Because
Although However Therefore Please Only Every All Some Both Neither Under Over Between During""".split()
HEAD_WORDS = """Rent Deposits Keys Guests Pets Noise Garden Cellar Laundry Exams Marks Lessons Uniform Absence Holidays Ward Visits Drugs Diet Discharge Postage Customs Returns Refunds Stock Orders Prices Delivery Members Fees Votes Minutes
Budget Records Forms Notes Tests Results Samples Limits Labels Repairs Spares Safety Alarms Doors Lights Water Power Heating Cleaning Shifts Training Complaints Changes Annexes Terms Scope Purpose Duties""".split()
TOPICS = """Opening Hours,House Rules,Fire Drill,Terms of Use,Waste Collection,Exam Results,Visiting Times,Payment Terms,Field Trip,General Remarks,Annual Report,Table of Contents,Lost Property,Dress Code,Parking,Hausordnung,
Öffnungszeiten,Règlement intérieur,Horaires d’ouverture,Normas de uso,Правила пользования,Расписание,利用規約,営業時間""".replace("\n", "").split(",")
MORE = "old new extra late early second only often again almost soon first whole small never other (draft) (old) also".split()

# Phrases that a person's name follows or goes before.
BEFORE_NAME = """please contact,I met,we spoke with,talked to,have a word with,message from,letter from,signed by,written by,approved by,on behalf of,handed over to,belongs to,given to,a call from,with kind regards from,addressed to,
as agreed with,thanks to,reported by,looked at by,in the name of,care of,attention of,the tenant is,our guest is,her neighbour,his brother,my colleague,the applicant,the witness,the patient,the pupil,the owner,the driver was,ask for,
look for,see,wait for,answer to,copy to,sent in by,Author:,Name:,Signed:,Attn:,From:,To:,Tenant:,Guardian:,Contact:,Caller:,Teacher:,Best wishes,Yours sincerely,Dear,cc,via,says,according to,kept by,held by,looked after by,done by,
returned to,not seen by,replaces,married to,hired by,interview with,born to,c/o,left with""".replace("\n", "").split(",")
AFTER_NAME = """wrote back,does not agree,objects to this,is on leave,called twice,has the key,lives next door,wants it changed,will come on Monday,said no,thinks otherwise,has been told,left a message,must be informed,is against it,agrees with that,
paid in cash,was late again,asked for a receipt,cannot come,rang the bell,signed the form,refuses,knows about it,will decide,needs a copy,has moved out,forgot the bag,was born here,came along,should be asked first,confirmed it,would rather wait,
may enter,has to sign,sent it back,opposes the plan,and the rest of the class,'s desk is empty,'s coat,is my teacher,shall be heard,took the photo,found the mistake,and I,was present,looks after it,is to be told first,isn't happy about it""".replace("\n", "").split(",")
NAME_BOTH = """The note by {name} was {deed}.;I saw {name} and {name} at the gate.;{name}, {name} and the {role} {time}.;The room of {name} is number {n}.;Is {name} in the {thing} list?;Did {name} get the {thing}?;{name} ({role}) has the {thing}.;
The {role}, {name}, was away.;{name}: {time};{name}, {date};{date}, {name};Seen {date} {name};Minutes: {name}. Chair: {name}.;Present: {name}, {name}, {name};{name};{name};{name}.;During a power cut {name}, {address}, holds the list.;When nobody opens {name} or {name} helps.;Heute {name};If the {device} stops {name} has to come.;Read by {name} on {date}.;Entered by {name}, {date}, desk {n}.;File {code} of {name} is missing.;
The {thing} of {name} has number {code}.;No answer from {name} so far.;{name} - please sign;ok with {name};{name} ok;not {name} again!;fine says {name};{name} thinks the {thing} {code} is wrong.;Where is {name}?;{name} has {deed} the {thing} {code}.;
Nobody but {name} may have the {brand} {device} {deed}.;She gave {name} the {thing}.;He and {name} {deed} the {thing}.;{name} from {firm} came {time}.;{name} of the {body} {deed} it.;Before {thing} {code} goes out, {name} has to be told.;
{name} must know before {thing} {code} is {deed}.;{name} was here, {name} was not.;{thing} {deed} by {name} {time};per {name} the {thing} stays;For {name}: {thing} {code}.;the {thing} is with {name};agreed with {name}, {num} % it is;{name} / {name}""".replace("\n", "").split(";")

# Carriers of the other kinds.
CARRIERS = """Ring {phone} and ask for {name}.;You can reach me on {phone}.;Phone: {phone};Tel: {phone};Mobile {phone}, evenings only;tried {phone}, nobody there;{phone} is engaged all day;Fax {phone};Her number is {phone}.;My new number: {phone};
Text {phone} when the {thing} is {deed}.;Emergency line {phone}, code {code}.;{name} {phone};{name}, {phone};{name} ({phone}) has the {thing}.;Get {name} on {phone} {time}.;Give {code} when you dial {phone}.;dial {phone} first;Hotline {phone} (Mon-Fri);
voicemail left at {phone};Before {thing} {code} is {deed}, call {phone}.;mobile no. {phone}.;the {role} is on {phone};number {phone} does not exist;{phone}, ask for the {role};Call {phone} or write to {email}.;
Mail {email} or {email}.;Send it to {email} {time}.;My address is {email}.;E-mail: {email};From: {email};Reply to {email} only;{name} <{email}>;{name} ({email}) objects.;{name}, {email}, wants the {thing}.;questions go to {email};write {email} before you sign;
About {thing} {code}: {email};copies {email}, {email};copied: {email} / {email};{email} bounced;Log in as {email}.;{email};Invite {email} too.;Mistakes in {code} should be sent to {email} at once.;for {code} see {name}, {email}.;
{name} lives in {address}.;Our new address: {address}.;Ship the {thing} to {address}.;Home: {address};The parcel for {name}, {address}, came back.;Moved from {address} to {address}.;Residence {address}, phone {phone};Visit us at {address}!;{name}, {address};
{address};Bill to: {address};pick it up at {address} {time};Driver goes to {address}; ask {email}.;Keys at {address}, c/o {name};It was left outside {address}.;the package for {address} with {name};private address given: {address};Send the {thing} {code} to {address}.;
If there is a fire call {name}, {address}, phone {phone}.;deliver {n} boxes to {address};
{id};Her {id} was copied.;The form shows {id} of {name}.;{name}, {id};{id} is the number of {name}.;scan shows {id}, remove it!;Please delete {id} from the {thing}.;Card holder: {id};The owner has {id}.;He was let in with {id}.;They noted {id} and {phone}.;
ID: {idv};His passport number is {idv}.;Her social security number is {idv}.;SSN: {idv};passport {idv} expires in {date};ID card no. {idv};The person with number {ssn} was let in.;the badge lists {ssn} for {name};{ssn} on the copy;number on the card is {ssn};
holder of {id};room {code} was opened for {id};tax file: {idv};licence of {name}: {idv}""".replace("\n", "").split(";")
FOREIGN = """Bitte wenden Sie sich an {name}.;Rufen Sie {name} unter {phone} an.;{name} ist im Urlaub.;Der Schlüssel liegt bei {name}.;Unterschrift: {name}, {date};{name} wohnt {address}.;Wohnhaft in {address}.;Telefon {phone}, abends;Die Nummer {phone} ist besetzt.;
Antwort bitte an {email}.;Fragen zu {code} an {name}, {email};Fragen dazu beantwortet {name}, {email}.;Der Mieter {name} hat gekündigt.;Mit {name} besprochen.;{name} war nicht da.;{id} steht auf dem Formular.;Anschrift: {address};Ihr Zeichen {code}, {name};Post an {address} senden.;
Veuillez contacter {name}.;{name} a signé le {date}.;Le dossier de {name} est complet.;Appelez le {phone} avant midi.;Tél. {phone};Écrire à {email}.;Adresse : {address};{name} habite {address}.;Remis à {name}, {address};J’ai vu {name} hier.;Son numéro est {id}.;
Selon {name}, la clé {code} est perdue.;Envoyer le colis au {address}.;Merci à {name}.;
Llame a {name} al {phone}.;{name} vive en {address}.;El paquete es para {name}.;Correo: {email};Su número es {id}.;Firmado por {name}, {date};Hablé con {name} ayer.;Dirección: {address};
Chiamare {name} al {phone}.;{name} abita in {address}.;Scrivere a {email}.;Firmato {name};Documento {id} di {name}.;Indirizzo: {address};Ho parlato con {name}.;
Proszę dzwonić do {name}, {phone}.;Adres: {address};Podpisał {name}.;Ligue para {name}, {phone}.;Fale com {name}.;Morada: {address};Bel {name} op {phone}.;
Звоните {rname} по номеру {phone}.;{rname} сегодня не работает.;Подпись: {rname}, {date};Документ проверил {rname}.;Ключ находится у {rname}.;Передать {rname}.;Проживает по адресу {raddress}.;Адрес: {raddress};Пишите на {email}.;Заявление подал {rname}.;
{rname} просит перезвонить: {phone}.;Паспорт {idv} выдан {rname}.;{rname};{rname} не согласен.;{rname} has {deed} the {thing}.;please contact {rname};Signed: {rname}, {date};We spoke with {rname} {time}.;File of {rname} has number {code}.;{rname} does not agree with that;ask {rname} first;
done by {rname};{rname} decides when {code} goes out.;{rname}, {email};{rname} ({phone}) has the key;for {rname}: {thing} {code};
{jname}さんに連絡してください。;担当者は{jname}です。;{jname}様、電話{phone}。;住所は{jaddress}です。;{jname}が確認しました。;連絡先：{email};署名：{jname};{jname}氏は欠席した。;{jname}先生の電話は{phone}。""".replace("\n", "").split(";")

# Sentences without personal information.
PLAIN = """Door {code} of the {brand} {device} is {deed} {time}.;The {brand} {device} with plate {code} runs at {n}0 rpm for {n} min.;{brand} is sold in boxes of {n}.;Add {num} g of {product} and stir {time}.;{product} lot {code} was {deed} {time}.;
Keep {product} at {n} °C ± {n} °C and {num} % humidity.;The {role} has the {thing} {code} {deed} {time}.;The {role} and the {role} {deed} the {thing}.;Ask the {role} first.;To be cleared with the {role}.;Talk to the {role} {time}.;The {body} and the {body} agree to {product}.;
The {body} meets {time}.;Send it to the {body}.;{trade} {firm} sends {product} on pallets, tag {code}; the {role} has the {thing} {deed}.;{trade} {firm} {deed} it.;{trade} {firm};{trade} {firm}, {place};the {trade} {firm} closes early;our {trade} {firm} {time};{firm} makes {product} {time}.;{firm} is the vendor, item {code}.;{do} {n} {thing} {code} {time}.;{do} {num} kg of {product} {time}.;{do} the {thing} {time}.;{do} each {device}, {time}.;{do} {num} L of {product}, {do} the {device} {code}.;{do} {thing} {code} for {product}.;
{brand}, {brand} and {brand} are words on tag {code}.;The {brand} panel says {brand}, {brand} and {brand}.;{product} for {product};as agreed for {product}.;used with {brand} {device};with {product} {time};stops the {device} for {product};{firm};bought from {firm};The {trade} is {firm}, no. {code}.;{trade} is {firm};{trade}: {firm}, {place};We chose {firm} as {trade}.;It was printed by {firm}.;{firm} ({place}) {deed} {n} boxes;on the way to {place};{place} is closed;
{brand} {brand} {device} {code};{brand}-{brand} {device} {deed} {time};the {topic} chapter;{topic}, page {n};{head};{n}.0 {head};{n} {head} (draft);{n}.{n} {head};{head} {code};see {head};{head}: {thing} {code};The offer of {firm} is {deed}.;{firm} {deed} the {thing} {time}.;written by {firm};
approved by the {body};signed by the {role} {time};Model {brand} {n} replaces {brand} {n}.;See page {n}, line {n}.;See {form}, section {n}.;Section {n}.{n} {topic};{n}.0 {topic};{topic};{topic} (draft);{n}.{n} {topic};
Form {dash5} is no longer valid for {product}.;Sheet {dash5} was {deed}, see {code}.;Part {dash5} fits the {device}.;Position {dash2} of the dial means off.;Value {dash2} is set on panel {code}.;Number {dash2} on the scale stays {deed}.;Setting {dash2} of the {device} is {deed}.;
Version {dots} of the {brand} software is out.;Routine {dots} of the {brand} {device} must not be changed.;Address {dots} of the router is fixed.;EAN {ean} stands under code {code}.;The strip {ean} is on each carton of {product}.;ISBN {isbn};Order number {cat} is for seal {code}.;
Item no. {cat} of the {brand} {device};Article {cat} is sold out.;Hall {n}, Gate {nnn} is for the {brand} {device}.;Building {n}, Floor {n} is {deed}.;Desk {n}, Room {nnn} keeps the {thing} {code}.;Street-level door {n} is {deed} {time}.;Bay @ gate {n} is drawn on plan {code}.;
Price @ {n}.50 each;{n} pieces @ {num} kg;The {thing} {nnnnn} of {product} costs {num} euros.;Between {num} % and {num} % the {role} tests again {time}.;The limit is {num} mg/kg until {date}, then {form} applies.;On {date} the {role} {deed} part {code} of the {device}.;
Due {date}.;Valid from {date} to {date}.;Accept from {date}.;Check {date};Opening hours {n}:30 to {n}:45.;Score {n}-{n}, ticket {code}.;Range {nnn}-{nnn} in table {n}.;Invoice 20{nn}-{nnnnn} is {deed}.;Ref. {code} / {code};{code} {deed};{code};see {code};{code} is fine;
{thing} | {num} % | {code} | yes;{thing} | {num} | {code};It covers 12 m² and ¾ of a page.;The word naïve is set in italics on {code}.;The label says “do not open” in red.;The label reads “NICHT STÜRZEN” beside {code}.;The sign says “DÉFENSE D’ENTRER” at gate {code}.;PRODUÇÃO and CUIDADO stand in capitals on {code}.;
Symbols ≠, ∑ and ∂ appear on display {code}.;The Greek panel of {product} reads Προσοχή.;The Polish sheet says Trzymać z dala od ognia.;The Czech leaflet {code} prints Upozornění and Složení.;The Turkish sheet of {product} lists Dikkat, Kullanım and Saklama.;The Hungarian panel shows Figyelem and Összetétel.;The Vietnamese card {code} reads Không mở cửa khi máy chạy.;The Swedish label prints Förvaras svalt and Innehåll.;The Icelandic word Þvottur is on tag {code}.;Amount: {n} µL of {product}.;Amount: {n}0 µm;The Ukrainian label for {product} reads Зберігати в темряві.;
Both γ-lactone and δ-decanol smell of fruit.;Lists of ω-acids and β-sheets;Bring the {thing}.;Same here.;Looks good to me.;Fine.;yes;No.;Text only, no objection.;Why is {code} missing?;Is it the same as {code}?;Was wrong before.;Unsure which {thing} is meant.;Set to low, see {form}.;Change in words only.;
No effect on {product}.;{product} is not affected.;{topic} was moved, text of {product} unchanged.;Rated too high.;Vote: {num} %.;Declined - the {thing} has to be {deed}.;This was a slip.;Copy of {code}.;{device} {code} out of use;
Each {thing} {nnnnn} from {device} {code} has to be {deed} {time}; under {num} % is fine.;If the {thing} {nnnnn} of {product} is {deed}, the {role} opens sheet {form} and tells the {role} {time}.;Copies {form} to {form} are {deed} by the {role} {time}.;
Weigh {num} mg of {product} on scale {code} and fill up to {n}0 mL.;Pour {num} mL into jar {code} and wash the {device} with {num} L.;The {device} {code} heats {product} up to {n}0 °C.;Guests don’t touch lid {code} – {product} is hot for {n} min.;
Rinse with {num} % vinegar for {n} min {time}.;{product} and {product} are mixed in tub {code}.;Cartons of {product} carry code {code} and {n}0 units.;The {role}’s list {form} is {deed}.;Tank {code} shows {num} Pa.;Filter {code} stands {num} bar {time}.;
Column {code} needs {n}0 µL of water, report in “{deed}” {time}.;Alarm {code} stops the {device}; restart needs {n} keys {time}.;The United Nations met in Geneva.;The British Museum opens at {n}.;He flew from Paris to Berlin on Monday.;She came back on Tuesday.;They left in May.;It is cold.;We agree.;
I think so.;You may go.;She said it was late.;He has the {thing}.;Nobody was there.;Everyone knows it.;Both {deed} it.;What a day!;In March the rent rises.;The French text is longer.;English and German only.;Easter is early this year.;The Danube rises.;
Die Hausordnung {code} gilt ab {date}.;Der Hausmeister prüft die Heizung bei {n} °C.;Für {product} gilt ein Wert von {num} %.;Das Gerät {form} muss {n} min abkühlen, bevor Deckel {code} geöffnet wird.;Die Lieferung {code} von {product} wird bis {date} geprüft.;Der Bericht liegt im Büro.;
Bitte die Tür schließen.;Die Bestellung wurde storniert.;Vor dem Spülen von Wanne {code} ist {product} zu entfernen.;Der Verein trifft sich am Montag.;
Le règlement {code} est affiché à l’entrée.;Avant d’entrer dans la salle {code}, vérifier que {product} reste sous {num} %.;La chaudière est réglée à {n} °C.;Le carton {code} de {product} pèse {num} kg ; voir la fiche {form}.;La réunion a lieu lundi.;L’ascenseur est en panne.;
La puerta {code} está cerrada.;El horario {form} vale desde {date}.;La biblioteca abre a las {n}.;La porta {code} è chiusa.;Il modulo {form} vale fino al {date}.;Drzwi {code} są zamknięte.;A porta {code} está fechada.;De deur {code} is dicht.;
Дверь {code} закрыта с утра.;Перед стиркой партию {code} сушат {n} минут и делают запись в тетради {form}.;Товар {code} лежит в подвале при {n} °C, опись в папке {form}.;Масса пакета {num} кг, жалобы принимает касса до вечера.;Инструкция: Не открывать, Беречь от влаги.;Трамвай ходит каждые {n} минут.;Окна моют весной и осенью.;Расписание занятий изменено, смотри стенд {code}.;Предел составляет {num} %, см. лист {code}.;Библиотека открыта по субботам.;Собрание жильцов в понедельник.;
図書館は{n}時に開く。;庭の水やりは{n}分以内とする。;掃除の後の道具は棚{code}に戻す。;食堂の温度は{n}°C、湿度は{num}%である。;遅刻の届けは用紙{form}に書いて出す。;給食の残りは{num}kgを超えない。;荷物{code}を運ぶ前に台車を{n}台用意する。;部品の数は箱{code}と同じである。;箱{code}は{n}°Cで保管し、表{form}に書く。;{product}の値は{num}%以下とする。;会議は月曜日に行う。;扉{code}を開ける前に{n}分待つ。""".replace("\n", "").split(";")


class Filler:
    """Values for the slots, from a seeded generator."""

    def __init__(self, rng: random.Random) -> None:
        self.r = rng

    def digits(self, n: int) -> str:
        return "".join(self.r.choice("0123456789") for _ in range(n))

    def groups(self, pattern: str) -> str:
        """A number pattern: 0 is any digit, A any capital; the rest stands as it is."""
        return "".join(self.digits(1) if c == "0" else self.r.choice("ABCDEFGHJKLMNPRSTUVWXYZ") if c == "A" else c for c in pattern)

    def stem(self) -> str:
        """One or two syllables, beginning with a capital."""
        out = "".join(self.r.choice(ONSETS) + self.r.choice(VOWELS) + (self.r.choice(CODAS) if self.r.random() < 0.5 else "") for _ in range(self.r.randint(1, 2)))
        return out.capitalize()

    # names
    def given(self) -> str:
        return self.r.choice(GIVEN) if self.r.random() < 0.45 else self.stem() + self.r.choice(["a", "o", "i", "us", "en", "e", "ine", "iel", "is", "ah", ""])

    def family(self) -> str:
        if self.r.random() < 0.3:
            return self.r.choice(FAMILY)
        end = self.r.choice(FAMILY_ENDS)
        f = self.stem() + (end if self.r.random() < 0.85 else "")
        return self.r.choice(["O'", "O’", "Mc", "Mac", "D’", "de ", "van ", "van der ", "von ", "Al-", "El ", "di ", "da "]) + f if self.r.random() < 0.07 else f

    def initial(self) -> str:
        return self.r.choice("ABCDEFGHIJKLMNOPRSTUVWYZ") + "."

    def name(self) -> str:
        r = self.r
        g, f, i, j, t = self.given(), self.family(), self.initial(), self.initial(), r.choice(TITLES)
        two = f"{f}-{self.family()}"
        if r.random() < 0.06:
            return self.rname()
        return r.choice([
            f"{g} {f}", f"{g} {f}", f"{g} {f}", f"{g} {f}", f"{g} {two}", f"{g} {i} {f}", f"{g} {i} {f}", f"{i} {f}", f"{i} {f}", f"{i} {j} {f}", f"{i} {j} {f}", f"{i}{j} {f}", f"{i} {two}", f, f, f, g, f"{t} {f}", f"{t} {f}", f"{t} {f}",
            f"{t} {g} {f}", f"{t} {i} {f}", f"{f}, {g}", f"{f.upper()}, {g}", f"{f.upper()}, {g}", f"{g} {f.upper()}", f"{f}, {i}", f"{g}  {f}", f"{g}  {f}", f"{t}  {f}", f"{g} {self.given()} {f}", two, f"{t} {two}",
        ])

    def rname(self) -> str:
        r = self.r
        man = r.random() < 0.5
        f = r.choice(CYRILLIC_FAMILY) + ("в" if man else "ва")
        if r.random() < 0.5:  # built from syllables
            f = "".join(r.choice("б в г д ж з к л м н п р с т х ч".split()) + r.choice("а е и о у я".split()) for _ in range(2)).capitalize() + r.choice(["нов", "нова", "лин", "лина", "ров", "рова", "ко", "ский", "ская", "вич", "дзе", "ян"])
        g, a, b = r.choice(CYRILLIC_GIVEN), r.choice("АБВГДЕИКЛМНОПРСТ"), r.choice("АБВГДИКМНПСФ")
        p = r.choice(PATRONYMIC) + ("вич" if man else "вна")
        return r.choice([f"{g} {f}", f"{f} {a}. {b}.", f"{a}. {b}. {f}", f"{a}.{b}. {f}", f"{f} {g} {p}", f"{g} {p}", f, f"{f} {g}", f"{a}. {f}"])

    def jname(self) -> str:
        return self.r.choice(HAN_FAMILY) + (self.r.choice(HAN_GIVEN) if self.r.random() < 0.6 else "")

    # the other kinds
    def phone(self) -> str:
        g = self.groups
        cc = str(self.r.choice([1, 7, 20, 27, 30, 31, 33, 34, 39, 44, 45, 46, 48, 49, 55, 61, 81, 86, 91, 351, 353, 358, 420]))
        return self.r.choice([
            f"+{cc} {g('000 000 000')}", f"+{cc} {g('00 0000 0000')}", f"+{cc} {g('0 00 00 00 00')}", f"+{cc}{g('0000000000')}", f"+{cc}{g('000000000')}", f"+{cc}-{g('000-000-0000')}", f"+{cc} (0){g('00 000000')}", f"+{cc} (0){g('000 00000')}",
            f"+{cc} ({g('000')}) {g('000-00-00')}", f"+{cc} (0){g('00 00000 000')}", f"00{cc} {g('0 00 00 00 00')}", f"00{cc} {g('000 0000000')}", f"00{cc} {g('00 00 00 00')}", g("(000) 000-0000"), g("(000) 000-0000"), g("000-000-0000"), g("000.000.0000"),
            g("000.000.0000"), g("000-0000"), g("000-0000"), g("0000 000000"), g("00000 000000"), g("00000 000000"), g("020 0000 0000"), g("0000 000 0000"), g("089 000000"), g("030 0000000"), g("06 00 00 00 00"), g("01 00 00 00 00"), g("8 (000) 000-00-00"),
            g("0000 000000") + f" ext. {self.digits(2)}", g("000 0000 0000") + f" ext. {self.digits(3)}", g("000-000-0000") + f" x{self.digits(3)}", g("(00) 0000-0000"), g("03-0000-0000"), g("090-0000-0000"), g("0000/000000"), g("+1 (000) 000-0000"), g("+1000000 0000"),
        ])

    def ssn(self) -> str:
        return self.groups("000-00-0000")

    def idv(self) -> str:
        """A number of a person without a word that says so."""
        g = self.groups
        return self.r.choice([self.ssn(), self.ssn(), g("A0000000"), g("AA0000000"), g("000000000"), g("A00000000"), g("AA 00 00 00 A"), g("00 00 000000"), g("0000 0000 0000"), g("00000000A"), g("L00A00A00"), g("00 000 000 000"), g("AAAAA000000AA0AA"), g("000.000.000-00")])

    def id(self) -> str:
        """A number of a person with the word that says so, or one that is known by its look."""
        g, r = self.groups, self.r
        no = r.choice(["", "", " no.", " number", " No", " no", ":", " #"])
        return r.choice([
            self.ssn(), self.ssn(), self.ssn(), f"SSN {self.ssn()}", f"social security{no} {self.ssn()}", f"SSN{no} {self.ssn()}", f"passport{no} {g('A0000000')}", f"passport{no} {g('000000000')}", f"passport{no} {g('AA0000000')}", f"Passport {g('A00000000')}",
            f"national ID{no} {g('00000000000')}", f"national identity card{no} {g('000000000')}", f"ID card{no} {g('AA000000')}", f"identity number {g('000000 0000')}", f"driver's license{no} {g('A000-0000-0000')}", f"driving licence{no} {g('AA000000A0')}",
            f"driving licence{no} {g('AAAAA 000000 AA')}", f"licence{no} {g('AA0000000')}", f"NI no. {g('AA 00 00 00 A')}", f"NI number {g('AA 00 00 00 A')}", f"National Insurance{no} {g('AA000000A')}", f"NHS number {g('000 000 0000')}", f"Medicare{no} {g('0000 00000 0')}",
            f"Personalausweis {g('L00A00A00')}", f"Ausweis-Nr. {g('A00000000')}", f"Ausweisnummer {g('L0A0A0A00')}", f"Ausweis-Nr. {g('A0000000A0')}", f"Reisepass-Nr. {g('C00A00A0A')}", f"Steuer-ID {g('00 000 000 000')}", f"Sozialversicherungsnummer {g('00 000000 A 000')}",
            f"numéro de sécurité sociale {g('0 00 00 00 000 000 00')}", f"passeport n° {g('00AA00000')}", f"carte d’identité {g('000000000000')}", f"DNI {g('00000000A')}", f"NIE {g('A0000000A')}", f"codice fiscale {g('AAAAAA00A00A000A')}", f"PESEL {g('00000000000')}",
            f"CPF {g('000.000.000-00')}", f"паспорт {g('00 00 000000')}", f"ИНН {g('000000000000')}", f"СНИЛС {g('000-000-000 00')}", f"Aadhaar {g('0000 0000 0000')}", f"BSN {g('000000000')}", f"マイナンバー{g('0000 0000 0000')}",
        ])

    def email(self) -> str:
        r = self.r
        plain = lambda s: re.sub(r"[^a-z]", "", s.lower()) or "info"
        g, f = plain(self.given()), plain(self.family())
        user = r.choice([f"{g}.{f}", f"{g}{f}", f"{f}{self.digits(2)}", f"{f}_{self.digits(3)}", f"{g[0]}{f}", f"{f}.{g[0]}", f"{g[0]}.{f}", f"{g}+news", f"{g}_{f}", f"{g}-{f}", g, f"{g}{self.digits(4)}", f"{g}.{f}+{self.stem().lower()}", "office", "info"])
        host = self.stem().lower()
        domain = r.choice([f"{host}.com", f"{host}.org", f"{host}.net", f"mail.{host}.com", f"{host}.co.uk", f"{host}-{self.stem().lower()}.de", f"{host}.fr", f"uni-{host}.edu", f"{host}.io", f"{host}.test", f"{host}{self.digits(1)}.example", f"{host}.info", f"{host}.{self.stem().lower()}"])
        dot = lambda s: domain.replace(".", s)
        return r.choice([f"{user}@{domain}"] * 8 + [f"<{user}@{domain}>", f"{user}@{domain}".upper(), f"{user}@{domain}".upper(), f"{user}(at){domain}", f"{user} (at) {domain}", f"{user}[at]{domain}", f"{user} [at] {dot(' [dot] ')}", f"{user} at {dot(' dot ')}", f"{user} (at) {dot(' (dot) ')}"])

    def place(self) -> str:
        p = self.stem() + self.r.choice(TOWN_ENDS)
        return self.r.choice([p, p, p, f"{self.r.choice(['Bad', 'Saint', 'St.', 'New', 'East', 'Upper', 'Great', 'Port', 'North'])} {p}", f"{p}-on-{self.stem()}", f"{p} {self.r.choice(['Bay', 'Park', 'Green', 'Falls', 'Bridge', 'Cross', 'Springs'])}", f"{p}-sur-{self.stem()}"])

    def road(self) -> str:
        r = self.r
        a = r.choice(ROAD_NAMES) if r.random() < 0.6 else self.stem() + r.choice(["", "s", "ton", "field"])
        return f"{a} {r.choice(ROAD_NAMES)}" if r.random() < 0.3 else a

    def address(self) -> str:
        r, g = self.r, self.groups
        n, m, p, s = r.randint(1, 240), r.randint(1, 60), self.place(), self.road()
        german = r.choice(GERMAN_PHRASES) if r.random() < 0.35 else r.choice(GERMAN_ROADS) + r.choice(GERMAN_ENDS) if r.random() < 0.7 else self.stem() + r.choice(GERMAN_ENDS)
        french = f"{r.choice(['rue', 'rue', 'avenue', 'place', 'chemin', 'impasse'])} {r.choice(FRENCH_ROADS)}"
        road = r.choice(ROADS)
        return r.choice([
            f"{n} {s} {road}, {p} {g('AA0 0AA')}", f"{n} {s} {road}, {p} {g('A00 0AA')}", f"{n} {s} {road}, {p}", f"{n}{r.choice('abc')} {s} {road}, {p}", f"{n} {s} {road}", f"{n + 1000} {s} {road}, {p}, {g('AA 00000')}", f"{n + 1000} {s} {road}, Apt {m}{r.choice('ABCD')}, {p}, {g('AA 00000')}",
            f"{n + 300} {s} {road}, Apt. {m}, {p} {g('00000')}", f"{n} {s} {road}, Unit {m}, {p}", f"flat {m}, {n} {s} {r.choice(HOUSES)}, {p}", f"Flat {m}, {s} {r.choice(HOUSES)}, {n} {s} {road}, {p}", f"apartment {m}, {n} {s} {road}, {p}",
            f"{german} {m}, {g('00000')} {p}", f"{german} {m}{r.choice('abc')}, {g('00000')} {p}", f"{german} {m} in {g('00000')} {p}", f"{german} {m}, {g('00000')} {p}", f"{n}, {french}, {g('00000')} {p}", f"{m} {r.choice(['bis', 'ter'])}, {french}, {g('00000')} {p}", f"{m} {french}, {g('00000')} {p}",
            f"C/ {r.choice(SPANISH_ROADS)} {m}, {g('00000')} {p}", f"Calle {r.choice(SPANISH_ROADS)} {m}, {m}º, {g('00000')} {p}", f"Via {r.choice(ITALIAN_ROADS)} {m}, {g('00000')} {p}", f"ul. {r.choice(POLISH_ROADS)} {m}, {g('00-000')} {p}", f"Rua {r.choice(SPANISH_ROADS)}, {m}, {g('0000-000')} {p}",
            f"{self.stem()}straat {m}, {g('0000 AA')} {p}", f"P.O. Box {n}, {p}", f"{n} {s} {road}, {p} {g('00000')}",
        ])

    def raddress(self) -> str:
        r = self.r
        town, road, n = r.choice(RUSSIAN_TOWNS), r.choice(RUSSIAN_ROADS), r.randint(1, 90)
        return r.choice([f"г. {town}, ул. {road}, д. {n}, кв. {n + 3}", f"ул. {road}, {n}, {town}", f"{self.digits(6)}, {town}, ул. {road}, д. {n}"])

    def jaddress(self) -> str:
        return f"{self.r.choice(JAPANESE_TOWNS)}{self.groups('0-0-0')}"

    # what is not personal
    def brand(self) -> str:
        b = self.stem() + self.r.choice(["a", "ex", "on", "tec", "ora", "ix", "ane", "el", "us", "", "quell", "star"])
        if self.r.random() < 0.25:  # with an accent
            at = self.r.randrange(len(b))
            accents = {"a": "áàâãåä", "e": "éèêë", "i": "íî", "o": "óôõöø", "u": "úüû", "c": "ç", "n": "ñ", "s": "šß", "z": "žż", "l": "ł", "A": "Å", "O": "Ö", "E": "É"}
            b = b[:at] + self.r.choice(accents.get(b[at], b[at])) + b[at + 1 :]
        return b

    def product(self) -> str:
        long = self.stem() + "".join(self.r.choice("ra li no ve mi ta do pe xa zu ri ole ani".split()) for _ in range(self.r.randint(1, 3))) + self.r.choice("n l x ne te s col rin zan via met".split())
        return self.r.choice([long, long, f"{long}-{self.groups('A0')}", f"{long}-{self.groups('A0')}", f"{long} {self.digits(2)}", f"{self.brand()}-{self.digits(2)}"])

    def firm(self) -> str:
        return self.r.choice([f"{self.brand()} {self.r.choice(FIRM_ENDS)}", f"{self.family()} {self.r.choice(FIRM_ENDS)}", f"{self.family()} & {self.family()} {self.r.choice(FIRM_ENDS)}", f"{self.brand()} {self.brand()} {self.r.choice(FIRM_ENDS)}", f"{self.brand()} {self.brand()}", f"{self.brand()}-{self.brand()} {self.place()}", f"{self.brand()} {self.stem()}", f"{self.place()} {self.r.choice(FIRM_ENDS)}"])

    def code(self) -> str:
        return self.groups(self.r.choice(["AA-00000", "AA00000/00", "00000-A", "A00000", "A-0000", "AA000", "0000-AA", "A00-000", "AAA-0000-A", "000000", "#0000", "A0000000/0", "AA 000", "00/0000"]))

    def form(self) -> str:
        return self.groups(self.r.choice(["A-0000.0", "AA-00", "A00.0", "F00", "A-000", "QA-0000", "0000/A"]))

    def date(self) -> str:
        month = self.r.choice("Jan Feb Mar Apr May Jun Jul Aug Sep Oct Nov Dec January June October".split())
        d, y = self.r.randint(1, 28), self.r.randint(1990, 2035)
        return self.r.choice([f"{d:02d} {month} {y}", f"{y}-{self.r.randint(1, 12):02d}-{d:02d}", f"{d}.{self.r.randint(1, 12)}.{y}", f"{month} {d}, {y}", f"{d}/{self.r.randint(1, 12)}/{y}"])

    def head(self) -> str:
        """A heading of several words in capitals."""
        a, b, c = (self.r.choice(HEAD_WORDS) for _ in range(3))
        return self.r.choice([f"{a} and {b}", f"{a} of {b}", f"{a} {b}", f"{a}, {b} and {c}", f"{a} for the {b}", f"{a} {b} and {c}", f"{a}-{b} {c}", f"{a} & {b}", a])

    def num(self) -> str:
        return self.r.choice([self.groups("0.0"), self.groups("00.0"), self.groups("0.00"), str(self.r.randint(1, 120)), self.groups("0,00")])

    def value(self, slot: str) -> str:
        if hasattr(self, slot):
            return getattr(self, slot)()
        if set(slot) == {"n"}:
            return str(self.r.randint(1, 99)) if slot == "n" else self.digits(len(slot))
        lists = {"role": ROLES, "device": DEVICES, "thing": THINGS, "deed": DEEDS, "time": TIMES, "body": BODIES, "topic": TOPICS, "trade": TRADES, "do": ORDERS}
        patterns = {"dash5": ["000-00-00000", "00-000-0000", "0000-000-00", "000-00-00000"], "dash2": ["000-0000-00", "00-000-00", "000-0000-00"], "dots": ["00.00.00.00", "0.00.0", "000.00.0.00", "0.0.0"], "ean": ["0000000000000", "00000000"], "isbn": ["000-0-00-000000-0"], "cat": ["0000-000-A", "00-000-A", "AA-000-00", "0000-000-0"]}
        return self.r.choice(lists[slot]) if slot in lists else self.groups(self.r.choice(patterns[slot]))


_SLOT = re.compile(r"\{(\w+)\}")
_KIND = {"id": "id_number", "idv": "id_number", "ssn": "id_number", "rname": "name", "jname": "name", "raddress": "address", "jaddress": "address"}


def _carrier(rng: random.Random, personal: bool) -> str:
    if not personal:
        return rng.choice(PLAIN)
    pick = rng.random()
    if pick < 0.3:  # a name between phrases, put together by rule
        before, after = rng.choice(BEFORE_NAME), rng.choice(AFTER_NAME)
        name = "{name}" if rng.random() < 0.93 else "{rname}"
        if rng.random() < 0.5:
            before = before[:1].upper() + before[1:]
        return rng.choice([f"{name} {after}", f"{name} {after}.", f"{before} {name}", f"{before} {name}.", f"{before} {name} {{time}}.", f"{before} {name}, {{time}}", f"{before} {name} and {name}.", f"{name} {after}, {{thing}} {{code}}.", f"{{thing}} {{code}} {before} {name}."]).replace(" 's", "'s")
    if pick < 0.52:
        return rng.choice(NAME_BOTH).strip()
    return rng.choice(CARRIERS if pick < 0.84 else FOREIGN).strip()


def _filled(carrier: str, fill: Filler) -> tuple[str, list[tuple[int, int, str]]]:
    out, spans, at = "", [], 0
    for m in _SLOT.finditer(carrier):
        out += carrier[at : m.start()]
        value = fill.value(m[1])
        if not out and value[:1].islower() and fill.r.random() < 0.8:
            value = value[:1].upper() + value[1:]
        kind = _KIND.get(m[1], m[1])
        if kind in KINDS:
            spans.append((len(out), len(out) + len(value), kind))
        out += value
        at = m.end()
    return out + carrier[at:], spans


def _garbled(text: str, codec: str) -> str:
    """The text's UTF-8 read in another encoding."""
    return "".join(bytes([b]).decode(codec, "ignore") or chr(b) for b in text.encode())


def _disturbed(text: str, spans: list[tuple[int, int, str]], rng: random.Random) -> tuple[str, list[tuple[int, int, str]]]:
    """The row with the disturbances of edited texts; spans move along."""
    if rng.random() < 0.05:
        text = "".join(c.upper() if len(c.upper()) == 1 else c for c in text)
    if rng.random() < 0.3:
        words = [m for m in re.finditer(r"\S+", text) if not any(a < m.end() and m.start() < b for a, b, _ in spans)]
        if words:
            m = rng.choice(words)
            kind = rng.random()
            new = rng.choice(MORE) if kind < 0.4 else f"{rng.choice(MORE)} {m[0]}" if kind < 0.6 else f"{m[0]} " if kind < 0.8 else "" if kind < 0.9 else str(rng.randint(1, 99))
            grow = len(new) - len(m[0])
            text = text[: m.start()] + new + text[m.end() :]
            spans = [(a + grow, b + grow, k) if a >= m.end() else (a, b, k) for a, b, k in spans]
    if rng.random() < 0.08:  # full-width forms, or a character that is not seen, in a word
        words = list(re.finditer(r"[A-Za-z]{3,}", text))
        if words:
            m = rng.choice(words)
            at = m.start() + rng.randint(1, len(m[0]) - 1)
            if rng.random() < 0.5:
                text = text[: m.start()] + "".join(chr(ord(c) + 0xFEE0) for c in m[0]) + text[m.end() :]
            else:
                text = text[:at] + rng.choice("\u200b\u00ad\u200c") + text[at:]
                spans = [(a + (a >= at), b + (b >= at), k) for a, b, k in spans]
    if rng.random() < (0.3 if sum(not c.isascii() for c in text) > 8 else 0.06):
        codec, out, moved, at = rng.choice(["cp1252", "latin_1", "mac_roman", "cp850", "cp437"]), "", [], 0
        for a, b, k in spans:
            out += _garbled(text[at:a], codec)
            inner = _garbled(text[a:b], codec)
            moved.append((len(out), len(out) + len(inner), k))
            out, at = out + inner, b
        text, spans = out + _garbled(text[at:], codec), moved
    return text, spans


def labelled_rows(rows: int = 24000, seed: int = 7) -> list[tuple[str, list[tuple[int, int, str]]]]:
    """``rows`` passages with their spans (start, end, kind), the same for the same seed."""
    rng = random.Random(seed)
    fill = Filler(rng)
    out = []
    for k in range(rows):
        text, spans = _disturbed(*_filled(_carrier(rng, k % 2 == 1), fill), rng)
        while rng.random() < 0.45 and len(text) < 600:  # sentences stand in passages
            more, others = _disturbed(*_filled(_carrier(rng, rng.random() < 0.3), fill), rng)
            gap = rng.choice([" ", " ", " ", "\n"])
            if rng.random() < 0.5:
                spans = spans + [(a + len(text) + len(gap), b + len(text) + len(gap), x) for a, b, x in others]
                text = text + gap + more
            else:
                spans = others + [(a + len(more) + len(gap), b + len(more) + len(gap), x) for a, b, x in spans]
                text = more + gap + text
        out.append((text, spans))
    return out
