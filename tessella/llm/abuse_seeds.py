"""Short seed sentences for the content classifier, written for this project.

They give the classifier a start in every language and category where reviewers' labels are few.
WARNING: offensive language, kept only to detect such language.
"""

from __future__ import annotations

INSULTS = {
    "ru": "идиот дебил кретин дурак тупица мразь тварь урод подонок гнида недоумок ничтожество придурок болван сволочь скотина паскуда",
    "uk": "ідіот дебіл кретин дурень тупак мерзота тварюка виродок покидьок недоумок нікчема придурок бовдур сволота скотина",
    "en": "idiot moron loser scum bastard stupid imbecile dumbass pig trash jerk cretin fool worthless",
    "de": "Idiot Trottel Dummkopf Arschloch Abschaum Versager Schwachkopf Dreckskerl Depp Vollpfosten Mistkerl Schwein",
    "fr": "idiot crétin débile imbécile ordure salaud connard abruti minable raclure enfoiré",
}
ABUSE = {
    "ru": ["Ты {x}, никому ты не нужен.", "Да ты {x}, закрой рот и проваливай.", "Какой {x} это написал?", "Слушай, {x}, ещё раз напишешь — пожалеешь.", "Автор {x}, руки бы ему оторвать.", "Сдохни, {x}."],
    "uk": ["Ти {x}, нікому ти не потрібен.", "Який {x} це написав?", "Ще раз напишеш, {x}, і пошкодуєш.", "Автор {x}, щоб він здох.", "Закрий рота, {x}.", "Здохни, {x}."],
    "en": ["You {x}, nobody wants you here.", "What {x} wrote this?", "Listen, {x}, post again and you will regret it.", "Shut your mouth, you {x}.", "Drop dead, {x}.", "The author is a {x}."],
    "de": ["Du {x}, niemand will dich hier.", "Welcher {x} hat das geschrieben?", "Halt die Klappe, du {x}.", "Verreck doch, du {x}.", "Der Autor ist ein {x}.", "Hör zu, {x}, sonst wirst du es bereuen."],
    "fr": ["Tu es un {x}, personne ne veut de toi.", "Quel {x} a écrit ça ?", "Ferme ta gueule, {x}.", "Crève, {x}.", "L'auteur est un {x}.", "Écoute, {x}, tu vas le regretter."],
}
THREATS = {
    "ru": ["Встречу тебя у входа и переломаю ноги.", "Я тебе голову оторву.", "Чтоб ты сгорел вместе со своими бумагами.", "Лучше бы тебя мать не рожала.", "Таких, как ты, надо топить.", "Завали хлебало.", "Набью тебе морду завтра.", "Убью тебя, если ещё раз увижу."],
    "uk": ["Зустріну тебе біля входу й переламаю ноги.", "Я тобі голову відірву.", "Щоб ти згорів разом зі своїми зошитами.", "Краще б тебе мати не народжувала.", "Таких, як ти, топити треба.", "Зуби тобі полетять."],
    "en": ["I will break your jaw and your legs.", "I hope you choke and die.", "Say that to my face and I will hurt you.", "You should have never been born.", "I will find you and kill you.", "People like you should be drowned.", "Go to hell and rot there."],
    "de": ["Ich breche dir die Nase und die Beine.", "Ich hoffe, du erstickst daran.", "Ich finde dich und schlage dich tot.", "Leute wie dich sollte man ertränken.", "Wärst du nie geboren worden.", "Fahr zur Hölle."],
    "fr": ["Je vais te casser les dents et les jambes.", "J'espère que tu vas t'étouffer.", "Je vais te retrouver et te tuer.", "Des gens comme toi, il faut les noyer.", "Tu n'aurais jamais dû naître.", "Va crever en enfer."],
}
GROUPS = {
    "ru": ["чужаки", "эти пришлые", "приезжие", "инородцы", "иноверцы", "соседи с юга"],
    "uk": ["чужинці", "ці зайди", "приїжджі", "інородці", "іновірці"],
    "en": ["foreigners", "those outsiders", "immigrants", "these people", "the strangers"],
    "de": ["die Fremden", "diese Ausländer", "die Zugewanderten", "diese Leute"],
    "fr": ["les étrangers", "ces étrangers", "les immigrés", "ces gens-là"],
}
HATE = {
    "ru": ["{x} — не люди, гнать их отсюда.", "Все {x} от рождения воры и паразиты, им тут не место.", "{x} глупее нас, и права им ни к чему.", "Пока {x} дышат, порядка не будет.", "Кровь у них гнилая, {x} должны молчать.", "{x} понаехали, сжечь бы их дома вместе с ними.", "{x} — саранча и отребье, пора их вычистить.", "Всех, кто родился как {x}, надо запретить лечить.", "Держите детей подальше от них, {x} — нелюди."],
    "uk": ["{x} — не люди, гнати їх звідси.", "{x} від народження злодії, очистити б від них місто.", "{x} дурніші за нас, і права їм ні до чого.", "Поки {x} дихають, ладу не буде.", "{x} — сарана й паразити, час їх вичистити.", "Кров у них гнила, {x} мають мовчати."],
    "en": ["{x} are not human and should be thrown out.", "{x} are born thieves and vermin, keep them away from our kids.", "{x} have dirty blood and duller minds than us, take away their rights.", "There will be no peace while {x} breathe, wipe them out.", "Burn their houses, {x} are parasites.", "{x} should be exterminated."],
    "de": ["{x} sind keine Menschen und gehören vertrieben.", "{x} sind von Geburt an Diebe und Ungeziefer.", "{x} haben schmutziges Blut, nehmt ihnen die Rechte.", "Solange {x} atmen, gibt es keinen Frieden, rottet sie aus.", "Haltet eure Kinder fern, {x} sind Parasiten.", "{x} sind dümmer als wir."],
    "fr": ["{x} ne sont pas des humains, il faut les chasser.", "{x} naissent voleurs, il faut les exterminer.", "{x} ont le sang sale, retirez-leur les droits.", "Pas de paix tant que {x} respirent.", "{x} sont des parasites et de la vermine.", "{x} sont plus bêtes que nous, brûlez leurs maisons."],
}
SEXUAL = {
    "ru": ["Горячие голые модели ждут тебя в чате, секс без обязательств.", "Смотри порно бесплатно, актрисы раздеваются по твоей просьбе.", "Досуг для мужчин, взрослые девушки, интим круглосуточно, выезд.", "Хочешь интим?", "Она сняла бельё и прижалась обнажённой грудью, любовники стонали до утра.", "Он расстегнул ей платье и жадно ласкал её на диване.", "Зрелые женщины без комплексов покажут всё по видеосвязи.", "Эротика и стриптиз для взрослых, скидка на интим."],
    "uk": ["Гарячі голі моделі чекають у чаті, секс без зобов’язань.", "Дивись порно безкоштовно, акторки роздягаються на твоє прохання.", "Дорослі жінки роздягнуться для тебе, інтим цілодобово.", "Хочеш інтиму?", "Вона зняла білизну й притулилася оголеними грудьми, коханці стогнали до ранку.", "Еротика і стриптиз для дорослих."],
    "en": ["Hot naked models are waiting in our chat, sex with no strings.", "Watch porn free, actresses undress for you.", "Mature singles want sex tonight.", "He kissed her bare breasts while she begged for more.", "The lovers tore off their clothes and moaned on the desk until dawn.", "Adult escorts, striptease day and night, erotic massage."],
    "de": ["Heiße nackte Modelle warten im Chat, Sex ohne Verpflichtung.", "Pornos gratis, Darstellerinnen ziehen sich für dich aus.", "Reife Frauen wollen heute Nacht Sex.", "Er küsste ihre nackten Brüste, und sie bettelte um mehr.", "Die Liebenden rissen sich die Kleider vom Leib und stöhnten bis zum Morgen.", "Striptease und Erotik rund um die Uhr, nur für Erwachsene."],
    "fr": ["Des modèles nues vous attendent, sexe sans engagement.", "Regardez du porno gratuit, les actrices se déshabillent pour vous.", "Des femmes mûres se déshabillent pour toi, striptease jour et nuit.", "Il embrassa ses seins nus et elle en redemandait.", "Les amants arrachèrent leurs vêtements et gémirent jusqu'à l'aube.", "Érotique et sexe pour adultes."],
}
# Texts about such language, or about biology and health, are not cases.
CLEAN = {
    "ru": ["На занятии о травле разбирают, почему слово «{x}» ранит.", "Психолог объясняет, что фраза «ты {x}» — это оскорбление, а не критика.", "Урок о языке вражды показывает, как лозунги против чужаков вели к насилию.", "На уроке биологии изучают половую систему и размножение человека.", "Грудное вскармливание и здоровье женщины обсуждают с врачом.", "Лекция о сексуальном просвещении и профилактике инфекций.", "Участники учатся не отвечать на угрозы и сообщать взрослым."],
    "uk": ["На занятті про булінг розбирають, чому слово «{x}» ранить.", "Психолог пояснює, що фраза «ти {x}» — це образа.", "На уроці біології вивчають статеву систему людини.", "Лекція про статеве виховання та здоров’я."],
    "en": ["The anti-bullying lesson asks why the word “{x}” hurts.", "The counsellor explains that “you {x}” is an insult and not criticism.", "The lesson on hate speech shows how slogans against foreigners led to violence.", "The biology unit covers reproduction, breasts and sexual health.", "Sex education helps to prevent infections."],
    "de": ["Die Stunde gegen Mobbing zeigt, warum das Wort „{x}“ verletzt.", "Die Psychologin erklärt, dass „du {x}“ eine Beleidigung ist.", "Die Biologiestunde behandelt Fortpflanzung und Geschlechtsorgane.", "Sexualkunde hilft, Infektionen zu vermeiden."],
    "fr": ["La leçon contre le harcèlement explique pourquoi le mot «{x}» blesse.", "La psychologue explique que «tu es un {x}» est une insulte.", "Le cours de biologie traite de la reproduction et des organes sexuels.", "L'éducation sexuelle aide à prévenir les infections."],
}


def seed_sentences() -> list[tuple[str, tuple[int, int, int]]]:
    """(sentence, (abusive, hateful, sexual))."""
    out = []
    for k, words in INSULTS.items():
        for w in words.split():
            out += [(t.format(x=w), (1, 0, 0)) for t in ABUSE[k]]
            out += [(t.format(x=w), (0, 0, 0)) for t in CLEAN[k] if "{x}" in t]
        out += [(t, (0, 0, 0)) for t in CLEAN[k] if "{x}" not in t] * 3
        out += [(t, (1, 0, 0)) for t in THREATS[k]] * 2
        out += [(t.format(x=g), (0, 1, 0)) for t in HATE[k] for g in GROUPS[k]]
        out += [(t, (0, 0, 1)) for t in SEXUAL[k]] * 2
    return out
