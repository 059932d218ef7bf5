"""Word lists and the words that decide categories and safety. Fixed values."""

# German stopwords of the keyword handler.
GERMAN = (
    "der die das den dem des ein eine einer einem einen eines ich du er sie es wir ihr mich dich sich uns euch mein dein sein unser euer "
    "dieser diese dieses jener jene jenes wer was wo wie wann warum welche welcher welches an auf aus bei bis durch für gegen in mit nach ohne "
    "um unter von vor zu zur zum über und oder aber auch als wenn weil dass damit ob ist sind war waren hat haben hatte hatten wird werden "
    "kann kannst können konnte muss musst müssen musste soll sollst sollen sollte wollte will willst wollen mag magst mögen mochte "
    "nicht kein keine keiner keinem keinen ja nein doch vielleicht wahrscheinlich ziemlich sehr mehr hier da dort heute jetzt immer noch schon bald wieder "
    "so nur denn dann obwohl amp im am beim vom"
).split()

# Words that are too common in the collection's field.
FIELD = (
    "patient patienten arzt ärzte mediziner therapie behandlung diagnose untersuchung labor klinik krankenhaus praxis fall fälle gruppe person personen patientin patientinnen "
    "ergebnis ergebnisse wert werte test tests prüfung datei dateien ordner verzeichnis pfad pfade name namen typ typus format formate größe länge breite höhe anzahl menge summe "
    "teil teile stück stücke art weise weg seite seiten gibt gab gengen finden fand liegen lag stehen stand geht ging kommt kam bleibt blieb"
).split()

# Stopwords of section keywords.
SECTION = (
    "der die das und oder mit fuer von auf in zu ist sind war wurden wird werden kann koennen eine einer einem einen als an auch bei bis durch "
    "hat nach nicht nur ob sich sie so sowie um unter vor wenn wie noch schon sehr wurde sein"
).split()

# Marks and words that make a query unsafe.
UNSAFE = (
    "-- ;-- ; /* */ @@ char nchar varchar nvarchar alter begin cast create cursor declare delete drop end exec execute fetch insert kill select sys sysobjects syscolumns table update xp_ 0x"
).split()

# Categories of PDF files and of images by what their path contains, in the order in which they are tried.
PDF = [("medizin_studien", ["medizin_studien", "medizin-studien"]), ("gesundheit", ["gesundheit"]), ("buecher", ["buecher", "bucher"]), ("aluminium", ["aluminium"])]
IMAGES = [("medizin_studien", ["medizin_studien", "medizin-studien"]), ("gesundheit", ["gesundheit"]), ("bilder", ["bild", "foto", "photo"])]
