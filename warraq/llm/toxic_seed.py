"""Labelled sentences to start the toxicity tagger from, written without regard to any table.

They exist so that such language can be recognised and reviewed. Each toxic pattern is labelled
toxic from its first to its last word, each harmless one not at all; ``{slots}`` are filled from
the lists below, ``{name}`` with invented words. What else a corpus holds is learned from its
reviewed documents (see ``toxicity.fit``).
"""

from __future__ import annotations

import random
import re

# The fillers, by slot.
FILL = {
    "en.noun": "moron idiot imbecile halfwit cretin dumbass asshole bastard pig rat cow leech parasite scum trash filth clown loser fool jerk swine dog donkey ass bitch whore slut prick dickhead wanker twat retard dimwit nitwit maggot worm cockroach coward liar shithead fucker motherfucker pervert creep",
    "en.adj": "ugly lazy stupid worthless pathetic miserable rotten brainless disgusting spineless useless filthy fat dumb dirty vile fucking damn idiotic ignorant",
    "en.group": "foreigners|immigrants|refugees|women|southerners|gypsies|old people|peasants|the poor|strangers|mountain folk|{name}|the {name}",
    "en.thing": "book letter parcel ticket ladder table window garden ship bridge",
    "de.noun": "Trottel Arschloch Dreckskerl Schwein Versager Abschaum Idiot Depp Esel Vollidiot Mistkerl Hund Schlampe Hure Wichser Penner Ratte Sau Schweinehund Dummkopf Hurensohn",
    "de.adj": "dummer nutzloser erbärmlicher widerlicher blöder fauler dreckiger hirnloser feiger",
    "de.group": "Ausländer|Fremden|Flüchtlinge|Zigeuner|Frauen|Südländer|{name}",
    "de.thing": "Buch Brief Paket Fenster Garten Schiff",
    "fr.noun": "crétin salaud porc connard minable abruti imbécile idiot con ordure chien âne déchet bâtard enculé débile salope pute raclure lâche",
    "fr.adj": "inutile stupide pitoyable dégoûtant répugnant minable sale puant",
    "fr.group": "étrangers|réfugiés|femmes|gitans|immigrés|{name}",
    "fr.thing": "livre billet colis jardin navire pont",
    "tr.noun": "salak asalak pislik aptal it gerizekalı eşek şerefsiz mal dangalak köpek domuz hayvan alçak orospu piç ahmak",
    "tr.adj": "beyinsiz zavallı iğrenç rezil aşağılık aptal pis değersiz korkak",
    "tr.group": "yabancılar|göçmenler|kadınlar|mülteciler|çingeneler|{name}",
    "tr.thing": "kitap mektup bilet bahçe gemi köprü",
    "ar.noun": "حمار كلب خنزير حقير غبي تافه قذر نذل حيوان وغد سافل أحمق جحش لئيم وسخ حثالة عاهرة وضيع بغل قرد جبان",
    "ar.the": "الحقير الغبي التافه القذر البائس الأحمق النذل السافل الوغد الوسخ الكلب الحمار الخنزير الجبان",
    "ar.group": "الغرباء|الأجانب|المهاجرين|النساء|اللاجئين|الغجر|{name}",
    "ar.thing": "كتاب رسالة تذكرة حديقة سفينة جسر",
}

# Toxic patterns.
TOXIC = {
    "en": [
        "{noun}", "{adj} {noun}", "you {noun}", "you {adj} {noun}", "you are such a {noun}", "you are nothing but a {adj} {noun}", "what an {adj} {noun} you are", "he is a {adj} {noun} and so is his brother", "listen, {noun}, nobody asked you", "oh look, the {noun} is back", "get lost, {noun}", "drop dead, you {adj} {noun}", "eat shit, {noun}", "you and your {adj} friends can rot",
        "screw you and your {adj} family", "your whole life is a waste, {noun}", "people like you make me sick", "how can anyone be so {adj}, you {noun}", "that {noun} could not find his own arse", "my cat is smarter than you, {noun}", "this is what happens when a {noun} is given a pen", "your head is full of shit", "everybody laughs at you behind your back, {noun}", "what kind of {noun} writes like that", "too {adj} to read, too {adj} to live",
        "i will smash your face", "i am going to stab you in your sleep", "you will be dead by friday", "somebody should shoot you", "i will burn your house down with you in it", "we are going to beat you until you bleed", "sleep with one eye open", "next time i see you i will cut your throat", "the world would be better without you, go jump off a roof", "please kill yourself and spare us", "you deserve to be run over", "i hope your children get cancer", "i hope you rot in a ditch", "nobody will miss you when you are gone", "your parents must regret the day they had you",
        "i despise {group}, they are filth", "{group} are parasites and must be wiped out", "{group} are a disease", "get the {group} out of our country", "{group} should be gassed", "we do not want {group} here, they stink", "a {group} is worth less than a dog", "you cannot trust {group}, they all steal", "{group} have no brains and no honour", "round up the {group} and hang them", "kill all {group}", "{group} are dumber than cattle", "keep {group} away from our schools", "{group} ruin everything they touch", "no decent person lets {group} into the house",
        "i want to fuck you hard", "show me your pussy", "he came all over her face", "she spread her legs and begged him to fuck her", "i would love to suck your tits", "my cock is throbbing for you", "bend over and take my dick", "she was dripping wet while he licked her clit", "send nudes", "i masturbate to your picture every night", "let me taste you between your thighs", "they had hot wet sex on the floor, moaning", "undress for me, slut", "he grabbed her naked breasts and pushed into her",
    ],
    "de": [
        "{noun}", "{adj} {noun}", "du {noun}", "so ein {adj} {noun}", "du bist doch ein {adj} {noun}", "ihr {noun} könnt mich mal", "hau ab, du {noun}", "leck mich am arsch, {noun}", "scheiß auf dich, {noun}", "du hast doch nur scheiße im kopf", "wie kann man nur so blöd sein, du {noun}", "dein ganzes leben ist ein witz, {noun}", "alle lachen über dich, {noun}",
        "ich schlage dir die zähne ein", "ich steche dich ab", "morgen bist du tot", "man müsste dich erschießen", "geh sterben, du {noun}", "häng dich auf", "ich zünde dein haus an", "du sollst elend krepieren", "niemand wird um dich weinen",
        "die {group} sind parasiten", "{group} sind der letzte dreck", "{group} gehören vergast", "schmeißt die {group} aus dem land", "man darf den {group} nicht trauen, sie klauen alle", "tötet alle {group}", "die {group} stinken und sind dumm wie vieh", "kein {group} soll unser haus betreten",
        "ich will dich hart ficken", "zeig mir deine muschi", "er spritzte ihr ins gesicht", "lutsch meinen schwanz", "sie spreizte die beine und stöhnte", "ich wichse jede nacht auf dein bild", "ich lecke deine nackten brüste",
    ],
    "fr": [
        "{noun}", "{noun} {adj}", "sale {noun}", "pauvre {noun}", "tu n'es qu'un {noun} {adj}", "casse-toi, {noun}", "va chier, {noun}", "je t'emmerde, {noun}", "t'as de la merde dans la tête", "comment peut-on être aussi con, {noun}", "tout le monde se moque de toi, {noun}", "ta vie entière est une blague, {noun}",
        "je vais te casser la gueule", "je vais te planter un couteau dans le dos", "demain tu seras mort", "on devrait te fusiller", "va te pendre", "je brûlerai ta maison avec toi dedans", "j'espère que tu crèveras seul", "personne ne pleurera pour toi",
        "les {group} sont des parasites", "les {group} sont une maladie", "mort aux {group}", "dehors les {group}, ils puent", "il faut exterminer les {group}", "on ne peut pas faire confiance aux {group}, ils volent tous", "les {group} sont plus bêtes que du bétail",
        "je veux te baiser fort", "montre-moi ta chatte", "il a joui sur son visage", "suce ma bite", "elle écarta les jambes en gémissant", "je me branle sur ta photo toutes les nuits", "je veux lécher tes seins nus",
    ],
    "tr": [
        "{noun}", "{adj} {noun}", "seni {noun}", "sen ne {adj} bir {noun} adamsın", "ulan {noun}", "bas git {noun}", "bok ye {noun}", "kafanın içi bok dolu", "ne kadar aptalsın {noun}", "herkes sana gülüyor {noun}", "senin bütün hayatın bir şaka {noun}", "ananı avradını {noun}",
        "ağzını burnunu kıracağım", "seni bıçaklarım", "yarın ölmüş olacaksın", "seni vurmak lazım", "git kendini as", "evini seninle birlikte yakacağım", "umarım yalnız gebersin", "kimse senin için ağlamaz",
        "{group} asalaktır", "{group} birer hastalıktır", "{group} defolsun, kokuyorlar", "{group} yok edilmeli", "{group} güvenilmez, hepsi çalar", "{group} hayvandan aşağı", "bütün {group} gebersin",
        "seni sert sikeceğim", "amını göster", "yüzüne boşaldı", "sikimi em", "kadın bacaklarını açıp inledi", "her gece fotoğrafına bakıp boşalıyorum", "çıplak göğüslerini yalamak istiyorum",
    ],
    "ar": [
        "يا {noun}", "أيها {the}", "{noun} ابن {noun}", "ما أنت إلا {noun}", "أنت {noun} وأبوك {noun}", "كل خرا يا {noun}", "انقلع من هنا يا {noun}", "كيف تكون غبيا هكذا يا {noun}", "الكل يضحك عليك أيها {the}", "رأسك مليء بالقذارة يا {noun}", "حياتك كلها نكتة أيها {the}", "هذا {the} لا يعرف شيئا",
        "سأحطم وجهك", "سأطعنك وأنت نائم", "غدا ستكون ميتا", "يجب أن يطلق عليك الرصاص", "اشنق نفسك وأرحنا", "سأحرق بيتك وأنت فيه", "أتمنى أن تموت وحيدا", "لن يبكي عليك أحد",
        "{group} طفيليات", "{group} مرض في البلاد", "الموت لكل {group}", "اطردوا {group} فهم نجس", "يجب إبادة {group}", "لا تثق في {group} فكلهم يسرقون", "{group} أغبى من البهائم",
        "أريد أن أنيكك بقوة", "أريني كسك", "قذف على وجهها", "مص قضيبي", "فتحت ساقيها وهي تتأوه", "أستمني على صورتك كل ليلة", "أريد أن ألحس ثدييك العاريين",
    ],
}

# Harmless patterns.
HARMLESS = {
    "en": [
        "she told the police that he had called her a {noun}", "nobody should be called a {noun} in this office", "the word {noun} is an insult and has been masked", "in the play the king shouts {noun} at the messenger", "users who write {noun} to others will be banned", "the novel quotes the slur {noun} and rejects it", "the report says that {group} were called {noun} and beaten", "it is wrong to say that {group} are parasites",
        "your argument is weak and the second table is wrong", "this software is awful and crashes all day", "the weather was miserable and the road was dirty", "this is a stupid mistake of mine", "i hate this printer", "the food was disgusting", "what a useless map", "that exam killed me",
        "the vet treated the dog, the pig and the cow", "a rat was seen near the kitchen", "the worm lives in wet soil", "the donkey carried a {thing}", "the actor plays a clown", "the cock crowed at dawn", "the breast of the chicken is roasted slowly", "the doctor examined the naked patient", "sexual reproduction in plants needs pollen", "condoms protect against infection", "the court sentenced the man who stabbed his neighbour", "the soldiers killed the guard and burned the gate", "he died of cancer last year", "the midwife explains how a child is born",
        "{group} worked in the harbour and sold salt", "many {group} came to the town in that year", "a law gave {group} the right to vote", "i lost my {thing} yesterday", "the {thing} is near the {thing}", "please send the {thing} by monday", "thank you for the {thing}", "we met at the {thing} and talked for hours", "prices rose by 3 percent", "the committee agreed on 4 points", "he will sleep with the window open", "come over tonight and bring the {thing}", "look at my face, i am tired", "you are a good friend", "you are such a help", "i will be home by friday", "nobody will be in the office on monday", "box 7, 3.5 kg, of 2019-04-02 (no. 12)", "ref. 31c, p. 40v, $250 and 60%", "12", "room 4b, row 9", "{thing} 14", "she licked the spoon", "he came all the way from the coast",
    ],
    "de": [
        "er zeigte den mann an, der ihn {noun} genannt hatte", "das wort {noun} ist eine beleidigung", "wer andere {noun} nennt, wird gesperrt", "im roman ruft der könig {noun}", "der tierarzt behandelt hund, schwein und esel", "das essen war widerlich", "dieses programm ist schrecklich", "ich hasse diesen drucker", "dein argument ist schwach", "die {group} arbeiteten am hafen", "viele {group} kamen in die stadt", "das {thing} liegt neben dem {thing}", "bitte schick das {thing} bis montag", "danke für das {thing}", "der mann wurde erstochen, sagt das gericht", "die ärztin untersucht den nackten patienten", "morgen bist du eingeladen", "ich zünde eine kerze an", "niemand ist im haus",
    ],
    "fr": [
        "il a porté plainte contre celui qui l'a traité de {noun}", "le mot {noun} est une insulte", "dans la pièce le roi crie {noun}", "le vétérinaire soigne le chien, le porc et l'âne", "le repas était dégoûtant", "ce logiciel est affreux", "je déteste cette imprimante", "ton argument est faible", "les {group} travaillaient au port", "beaucoup de {group} vinrent en ville", "le {thing} est près du {thing}", "envoie le {thing} avant lundi", "merci pour le {thing}", "le tribunal a condamné le meurtrier", "le médecin examine le patient nu", "demain tu seras invité", "personne ne viendra lundi",
    ],
    "tr": [
        "kendisine {noun} diyen adamı şikâyet etti", "{noun} kelimesi bir hakarettir", "oyunda kral {noun} diye bağırır", "veteriner köpeği, domuzu ve eşeği muayene etti", "yemek iğrençti", "bu program berbat", "bu yazıcıdan nefret ediyorum", "savın zayıf", "{group} limanda çalışırdı", "şehre çok {group} geldi", "{thing} masanın yanında", "lütfen {thing} pazartesiye kadar gelsin", "{thing} için teşekkürler", "mahkeme katili mahkûm etti", "doktor çıplak hastayı muayene etti", "yarın davetlisin", "kimse evde değil",
    ],
    "ar": [
        "شكا الرجل الذي سماه {noun}", "كلمة {noun} إهانة لا نقبلها", "في المسرحية يصيح الملك يا {noun}", "عالج الطبيب الكلب والحمار والخنزير", "كان الطعام سيئا جدا", "هذا البرنامج رديء", "أكره هذه الطابعة", "حجتك ضعيفة", "عمل {group} في الميناء", "جاء كثير من {group} إلى المدينة", "وضعت {thing} قرب الباب", "أرسل {thing} يوم الاثنين", "شكرا على {thing}", "حكمت المحكمة على القاتل", "فحص الطبيب المريض عاريا", "غدا أنت ضيفنا", "لا أحد في البيت",
    ],
}

_SLOT = re.compile(r"\{(\w+)\}")
# Letters of invented names.
_LETTERS = {"ar": "بتجدرسعفقكلمن", "": "abdegiklmnorstuvz"}


def patterns() -> list[tuple[str, str, bool]]:
    """(language, pattern, toxic) of all patterns."""
    return [(lang, p, toxic) for table, toxic in ((TOXIC, True), (HARMLESS, False)) for lang in table for p in table[lang]]


def sentences(chosen: list[tuple[str, str, bool]] | None = None, per_pattern: int = 10, seed: int = 7) -> list[list[tuple[str, bool]]]:
    """Token-labelled sentences: every pattern filled several times, some joined with a harmless one of its language."""
    rng = random.Random(seed)
    chosen = patterns() if chosen is None else chosen
    lists = {k: (v.split("|") if "|" in v else v.split(" ")) for k, v in FILL.items()}
    harmless = {lang: [p for x, p, toxic in chosen if x == lang and not toxic] for lang in TOXIC}

    def one(lang: str, slot: str) -> str:
        if slot == "name":
            return "".join(rng.choice(_LETTERS["ar" if lang == "ar" else ""]) for _ in range(rng.randint(4, 8)))
        return fill(lang, rng.choice(lists[f"{lang}.{slot}"]))

    def fill(lang: str, pattern: str) -> str:
        return _SLOT.sub(lambda m: one(lang, m.group(1)), pattern)

    out: list[list[tuple[str, bool]]] = []
    for lang, p, label in chosen:
        times = per_pattern * (1 + len(_SLOT.findall(p))) // 2
        for _ in range(max(2, times * (4 if len(p.split()) <= 2 and label else 1))):
            s = [(fill(lang, p), label)]
            if harmless[lang] and rng.random() < 0.4:  # text without a stop between two sentences
                other = (fill(lang, rng.choice(harmless[lang])), False)
                s = [other, *s] if rng.random() < 0.5 else [*s, other]
            out.append(s)
    rng.shuffle(out)
    return out
