"""Words that n-grams leave out, by language."""

from __future__ import annotations

#: Words of web pages that say nothing.
WEB = "home page click read next previous back top menu close open search login sign submit loading"
#: Frequent words of each language.
EN = """a about above after again against all also am an and any are as at be because been before being
below between both but by can could did do does doing down during each even few for from further
get got had has have having he her here hers herself him himself his how i if in into is
it its itself just know let like ll make may me might more most much must my myself need no
nor not now of off on once one only or other our ours ourselves out over own per really re
s said same say she should since so some still such take t than that the their theirs them
themselves then there these they this those through to too under until up us ve very want was
we well were what when where which while who whom why will with won would you your yours
yourself yourselves"""
ES = """a al algo algunas algunos ante antes como con contra cual cuando de del desde donde durante e el ella
ellas ellos en entre era esa esas ese eso esos esta estaba estado estar estas este esto estos fue
ha hace hacia hasta hay la las le les lo los mas me mi muy na ni no nos nosotros nuestro
nuestra o os otra otras otro otros para pero por que quien se ser si sin sino sobre somos son
soy su sus te ti tiene todo todos tu tus un una unas uno unos usted ustedes y ya yo"""
FR = """a ai au aux avec avons c ce ces comme d dans de des du elle elles en es est et eu
eux fait il ils j je l la le les leur leurs lui ma mais me mes mon n ne ni nos
notre nous on ont ou par pas plus pour qu que qui s sa se ses si son sont sur ta
te tes ton tu un une vos votre vous y"""
DE = """aber alle allem allen aller als also am an ander andere anderem anderen anderer anderes auch auf aus
bei bin bis bist da damit dann das dass dazu dem den denn der des die dies diese diesem diesen
dieser dieses doch dort du durch ein eine einem einen einer er es etwas euch euer eure eurem
euren eurer für gegen hab habe haben hat hatte ich ihm ihn ihnen ihr ihre ihrem ihren ihrer
im in ist jede jedem jeden jeder jedes kann kein keine keinem keinen keiner man mein meine
meinem meinen meiner mit muss müssen nach nicht nichts noch nun nur ob oder ohne sehr sein seine
seinem seinen seiner sich sie sind so soll und uns unser unsere unserem unseren unserer unter um
von vor was weil welch welche welchem welchen welcher wenn wer werde wie will wir wird wo
würde zu zum zur über"""
PT = """a ao aos aquela aquelas aquele aqueles aquilo as com como da das de dela delas dele deles depois
do dos e ela elas ele eles em entre era essa essas esse esses esta estas este estes eu foi
isso isto lhe lhes lo mais mas me mesmo meu minha muito na nas nem no nos nossa nossas
nosso nossos num numa nuns o os ou para pela pelas pelo pelos por qual quando que quem se sem
ser seu seus sua suas te tem teu teus tu tua tuas um uma umas uns"""
IT = """a abbiamo ad ai al alla alle allo anche avere aveva che chi ci come con contro cui da dal
dalla dalle dallo degli dei del dell della delle dello di dopo e era essere fatto fra fu gli
ha hai hanno ho i il in io l la le lei li lo loro lui ma me mi mia mie miei mio
ne nei nel nella nelle nello no noi non nostra nostre nostri nostro o per piu quale quando quello
questa queste questi questo se si sia sono su sua sue sui sul sulla sulle sullo suo suoi ti
tra tu tua tue tuo tuoi tutti tutto un una uno vi voi vostra vostre vostri vostro"""
NL = """aan al alles als bij daar dan dat de der die dit doch doen door dus een en er ge geen haar
had heeft hem het hier hij hoe hun iets ik in is ja je kan kon maar me meer men met mij
mijn moet na naar niet niets nog nu of om omdat ook op over reeds te tegen toch toen tot u uit
uw van veel voor want waren was wat we wel werd wij wil worden wordt zal ze zelf zich zij
zijn zo zou"""
PL = """a ale ani az bardzo bez bo by byla byli bylo byl byc co czy dla do go i ich jak jako ja
je jednak jego jej jest jeszcze juz kiedy ku ma mi mnie moze mozna mu na nad nam nas nie nich
nic nim no o od on ona oni ono oraz po pod przez przy sa sie so ta tak tam te tego tej
ten to tu tylko ty tych tym w wie wiele wszystko z za ze"""
SV = """alla allt att av bara bli blivit de den denna det detta dig din dina dit dock du efter
eller en er era ett finns från gav ger ha hade han hans har hen hennes hon honom
hur i in ingen inte ja jag kan kunde man med men mig min mina mot mycket ni nu
och om oss som till under upp ur ut vad var vara vi vid vill"""
DA = """ad af aldrig alle alt anden andet andre at bare begge blev da de dem den denne der deres det
dette dig din dine disse dit dog du efter eller en end er et for fordi fra gik han hans
har havde hen hende hendes her hos hun hvad hvem hver hvilken hvis hvor i igen ikke ind ingen
ja jeg kan kom kunne lidt man mange med meget men mig min mine mit mod ned nej noget nogle
nu og op os over selv sig sin sine sit skal skulle som til ud var"""
TR = """acaba ama ancak bana bir biri birisi biz bu bunu da daha de defa diye eger en gibi hem henuz
hep hepsi her herkes hi ic icin ile ise ki kim kimi mu nasil ne neden nerde nerede nereye
niye o ona onlar onu onun sana sen siz su ve veya ya yani"""
BY_LANGUAGE = {"en": EN, "es": ES, "fr": FR, "de": DE, "pt": PT, "it": IT, "nl": NL, "pl": PL, "sv": SV, "da": DA, "tr": TR}


def stopwords(language: str = "en") -> tuple[str, ...]:
    """English, the language's own, if it is known, and those of web pages."""
    texts = [EN, BY_LANGUAGE.get(language, ""), WEB]
    return tuple(dict.fromkeys(w for t in texts for w in t.split()))
