"""Broker events, routes and operations of JavaScript and TypeScript texts."""

import pytest

from weftline.sources import extract
from weftline.sources import javascript as J


def events(text, exact=True):
    return {(e["role"][0].upper(), e["name"]) for e in J.events(J.Script(text)) if e["heuristic"] != exact}


def routes(text):
    return [f"{r['method']} {r['path']}" for r in J.routes(J.Script(text))]


KAFKA = "import { Kafka } from 'kafkajs';\nconst kafka = new Kafka({});\nconst producer = kafka.producer();\nconst consumer = kafka.consumer({ groupId: 'g' });\n"

CASES = {
    "kafkajs": (KAFKA + "producer.send({ topic: 'a' }); producer.sendBatch({ topicMessages: [{ topic: 'b', messages: [] }, { topic: 'c' }] });\nconsumer.subscribe({ topics: ['d', 'e'] }); bus.send({ topic: 'no' });", {"Pa", "Pb", "Pc", "Cd", "Ce"}),
    "named like a producer": ("orderProducer.send({ topic: 'x' }); KAFKA_CONSUMER.subscribe({ topic: 'y' }); mailer.send({ topic: 'no' }); request(app).producer().send({ topic: 'no2' });", {"Px", "Cy"}),
    "rdkafka": ("const K = require('node-rdkafka');\nconst p = new K.Producer({});\np.produce('t', null, b); other.produce('no'); const c = new K.KafkaConsumer({}); c.subscribe(['u', 'v']);", {"Pt", "Cu", "Cv"}),
    "rdkafka needs its import": ("p.produce('t'); c.subscribe(['u']);", set()),
    "kafka-node": ("import { Consumer, ConsumerGroup, Producer, KafkaClient } from 'kafka-node';\nconst client = new KafkaClient();\nnew Consumer(client, [{ topic: 'a' }], {}); new ConsumerGroup(o, ['b', 'c']); const p = new Producer(client); p.send([{ topic: 'd', messages: 1 }], cb);", {"Ca", "Cb", "Cc", "Pd"}),
    "platformatic": ("import { Producer, Consumer } from '@platformatic/kafka';\nconst producer = new Producer({}); const consumer = new Consumer({});\nproducer.send({ messages: [{ topic: 'a' }] }); consumer.consume({ topics: ['b'] });", {"Pa", "Cb"}),
    "redis": ("import Redis from 'ioredis';\nconst redis = new Redis();\nredis.publish('a', m); redis.subscribe('b', 'c', () => 1); redis.xadd('s', '*', 'k', 1); redis.xread('COUNT', 1, 'STREAMS', 's1', 's2', '0', '0'); eventBus.publish('no');", {"Pa", "Cb", "Cc", "Ps", "Cs1", "Cs2"}),
    "node-redis": ("import { createClient } from 'redis';\nconst client = createClient();\nclient.xRead([{ key: 'k1', id: '0' }]); client.xReadGroup('g', 'c', { key: 'k2', id: '>' }); client.brPop('q', 0); client.bRPop('q2', 0); client.lPush('w', x); client.lMove('src', 'dst', 'LEFT', 'RIGHT');", {"Ck1", "Ck2", "Cq2", "Pw", "Csrc", "Pdst"}),
    "blocking pop keeps keys only": ("import Redis from 'ioredis'; const r = new Redis(); r.brpop('q1', 'q2', '0');", {"Cq1", "Cq2"}),
    "no broker loaded": ("this.publish('a'); emitter.subscribe('b'); http.send({ topic: 'c' }); socket.emit('d');", set()),
    "nats": ("import { connect } from 'nats';\nasync function f() { const nc = await connect({}); nc.publish('a', d); nc.request('b'); nc.subscribe('c.>'); }", {"Pa", "Pb", "Cc.>"}),
    "jetstream": ("import { jetstream } from '@nats-io/jetstream'; const js = jetstream(nc); js.publish('x.y');", {"Px.y"}),
    "mqtt": ("import mqtt from 'mqtt';\nconst client = mqtt.connect('u');\nclient.publish('a/b', 'm'); client.subscribe(['c', 'd']); client.subscribe({ 'e/+': { qos: 1 } });", {"Pa/b", "Cc", "Cd", "Ce/+"}),
    "amqp": ("const amqp = require('amqplib');\nconst conn = await amqp.connect('u'); const ch = await conn.createChannel();\nch.sendToQueue('q', b); ch.consume('r', f); ch.publish('ex', 'key', b); ch.publish('', 'direct', b);", {"Pq", "Cr", "Pex"}),
    "bullmq": ("import { Queue, Worker } from 'bullmq';\nnew Queue('mail'); new Worker('mail', async () => 1); new Worker('./worker.js');", {"Pmail", "Cmail"}),
    "bullmq unbound": ("export const q = new Queue('jobs'); const w = new Worker('/path/w.js');", {"Pjobs"}),
    "a class of the file is no queue": ("class Queue {}\nnew Queue('x');", set()),
    "bull": ("import Bull from 'bull';\nconst emails = new Bull('emails'); emails.process(async () => 1);", {"Pemails", "Cemails"}),
    "sqs and sns": ("import { SQSClient, SendMessageCommand, ReceiveMessageCommand } from '@aws-sdk/client-sqs';\nimport { PublishCommand } from '@aws-sdk/client-sns';\nnew SendMessageCommand({ QueueUrl: 'https://sqs.eu/123/orders' }); new ReceiveMessageCommand({ QueueUrl: url }); new PublishCommand({ TopicArn: 'arn:aws:sns:eu:1:paid' }); new PublishCommand({ TopicArn: 'x:y' });", {"Porders", "Ppaid"}),
    "aws v2": ("const AWS = require('aws-sdk');\nconst sqs = new AWS.SQS(); sqs.sendMessage({ QueueUrl: 'https://x/1/q' }); sqs.receiveMessage({ QueueUrl: 'https://x/1/r' });", {"Pq", "Cr"}),
    "pubsub": ("import { PubSub } from '@google-cloud/pubsub';\nconst ps = new PubSub(); ps.topic('a').publishMessage({}); ps.topic('b').subscription('s'); ps.publish('no');", {"Pa", "Cb"}),
    "pulsar, service bus, event hubs": ("import Pulsar from 'pulsar-client'; import { ServiceBusClient } from '@azure/service-bus'; import { EventHubProducerClient } from '@azure/event-hubs';\nconst pc = new Pulsar.Client({}); pc.createProducer({ topic: 'a' }); pc.subscribe({ topics: ['b'] }); const sb = new ServiceBusClient(c); sb.createSender('q'); sb.createReceiver('r'); new EventHubProducerClient('Endpoint=sb://x;Key=1', 'hub');", {"Pa", "Cb", "Pq", "Cr", "Phub"}),
    "nest client": ("import { ClientProxy } from '@nestjs/microservices';\nclass A { constructor(@Inject('X') private readonly bus: ClientProxy, private client: ClientKafka) {}\n f() { this.bus.emit('a', 1); this.client.send('b', 1); this.server.emit('no'); } }", {"Pa", "Pb"}),
    "nest patterns": ("import { EventPattern, MessagePattern } from '@nestjs/microservices';\nclass A { @EventPattern('e') on() {}\n @MessagePattern('m') ask() {} }", {"Ce", "Cm"}),
    "a client without the package": ("this.client.emit('a'); res.send('b');", set()),
    "decorators": ("import { Processor, InjectQueue } from '@nestjs/bull'; import { RabbitSubscribe, RabbitRPC } from '@golevelup/nestjs-rabbitmq'; import { SqsMessageHandler } from '@ssut/nestjs-sqs';\n@Processor({ name: 'p' }) class A { constructor(@InjectQueue('q') q) {}\n @RabbitSubscribe({ queue: 'r', routingKey: 'no' }) a() {}\n @RabbitRPC({ routingKey: 's' }) b() {}\n @SqsMessageHandler('t') c() {} }", {"Cp", "Pq", "Cr", "Cs", "Ct"}),
    "kinesis, event bridge, stomp": ("import { PutRecordCommand } from '@aws-sdk/client-kinesis'; import { PutEventsCommand } from '@aws-sdk/client-eventbridge'; import { Client } from '@stomp/stompjs';\nnew PutRecordCommand({ StreamName: 'k' }); new PutEventsCommand({ Entries: [{ DetailType: 'd' }, { EventBusName: 'b' }] }); const st = new Client(); st.publish({ destination: '/q' }); st.subscribe('/t', f);", {"Pk", "Pd", "Pb", "P/q", "C/t"}),
}


@pytest.mark.parametrize("name", CASES)
def test_brokers(name):
    text, want = CASES[name]
    assert {r + n for r, n in events(text)} == want


def test_names():
    text = "const A = 'a'; let B = 'no'; const T = Object.freeze({ X: 'x', N: { Y: 'y' } }); enum E { M = 'm' } class S { static readonly F = 'f'; private topic = 'g';\n go() { producer.send({ topic: this.topic }); } }\n"
    text += "".join(f"producer.send({{ topic: {e} }});\n" for e in ("A", "B", "T.X", "T['N'].Y", "E.M", "S.F", "`${A}-1`", "A + '.' + E.M", "(A as string)", "unknown", "`${unknown}`"))
    assert {n for _, n in events(text)} == {"a", "x", "y", "m", "f", "g", "a-1", "a.m"}
    assert events("const T = 't';\nfor (const T of all) { producer.send({ topic: T }); }") == events("const T = 't'; function f(T) { producer.send({ topic: T }); }") == set()
    text = "import { TOPIC, Names } from './t'; import type { Other } from './o';\nproducer.send({ topic: TOPIC }); producer.send({ topic: Names.PAID }); producer.send({ topic: Names.paid }); producer.send({ topic: Other.X });"
    assert events(text, exact=False) == {("P", "TOPIC"), ("P", "Names.PAID")} and events(text) == set()


def test_routes():
    express = "import express from 'express';\nconst app = express(); const users = express.Router(), admin = express.Router();\n"
    assert routes(express + "app.get('/a', h); app.post(['/b', '/c'], mw, (q, r) => 1); app.get('setting'); axios.get('/no', c); app.del('/d', h); app.all('*', h);") == ["GET /a", "POST /b", "POST /c", "DELETE /d", "ALL *"]
    assert routes(express + "users.get('/:id', show); app.use('/api', users); app.use('/v2', auth, users);") == ["GET /api/:id", "GET /v2/:id"]
    assert routes(express + "const inner = express.Router(); inner.get('/x', h); users.use('/in', inner); app.use('/api', users); inner.use('/loop', users);") == ["GET /api/in/x", "GET /loop/in/x"]
    assert routes("import { Router } from 'express'; export function make(router) { router.get('/p', h); cache.get('/no', h); }") == ["GET /p"]
    assert routes("cache.get('/no', h); router.get('/no', h);") == []
    assert routes("import { Hono } from 'hono';\nconst app = new Hono().basePath('/api'); const sub = new Hono();\nsub.get('/s', (c) => c.text('x')); app.route('/sub', sub); app.on(['GET', 'POST'], '/p', h);") == ["GET /api/sub/s", "GET /api/p", "POST /api/p"]
    assert routes("import Fastify from 'fastify'; const f = Fastify(); f.route({ method: ['GET', 'PUT'], url: '/q', handler });") == ["GET /q", "PUT /q"]
    assert routes("import Router from '@koa/router'; const router = new Router({ prefix: '/k' }); router.get('user', '/u/:id', h);") == ["GET /k/u/:id"]
    nest = "import { Controller, Get, Post } from '@nestjs/common'; import { Put } from './orm';\n@Controller('users')\nexport class C { @Get(':id') one() {} @Post() make() {} @Put('no') x() {} }\n@Controller({ path: 'y' }) class D { @Get(['a', 'b']) m() {} }"
    assert routes(nest) == ["GET /users/:id", "POST /users", "GET /y/a"]
    many = {"r": [(f"/p{k}", None) for k in range(9)], "a": [("/a", "b")], "b": [("/b", "a")]}
    assert len(J.prefixes(many, "r")) == 4 and J.prefixes(many, "a") == ["/b/a"]


def test_operations():
    trpc = "import { initTRPC } from '@trpc/server';\nexport const postRouter = router({ list: publicProcedure.query(() => 1), deep: router({ one: t.procedure.input(z).mutation(f) }) });\nexport const appRouter = router({ post: postRouter, me: publicProcedure.subscription(x), no: db.query(y) });\n"
    assert {p["name"] for p in J.procedures(J.Script(trpc))} == {"TRPC query post.list", "TRPC mutation post.deep.one", "TRPC subscription me"}
    maps = "import { ApolloServer } from '@apollo/server';\nconst userResolvers: Resolvers = { Query: { users() {}, 'a-b': () => 1 }, User: { x() {} } }; new S({ resolvers: { Mutation: { async add() {} } } }); const other = { Query: { no() {} } };"
    assert [p["name"] for p in J.procedures(J.Script(maps))] == ["GRAPHQL Query users", "GRAPHQL Query a-b", "GRAPHQL Mutation add"]
    marks = "import { Query as Q, Resolver } from '@nestjs/graphql'; import { Query } from '@nestjs/common';\n@Resolver() class R { @Q(() => User, { name: 'author' }) get() {}\n @Q(() => [User])\n async all() {}\n @Q('named') z() {} y(@Query('no') n) {} }"
    assert [p["name"] for p in J.procedures(J.Script(marks))] == ["GRAPHQL Query author", "GRAPHQL Query all", "GRAPHQL Query named"]
    assert J.exports(J.Script("export const GET = 1; export async function POST() {}\nexport default h3.defineEventHandler(() => 1); export { a as b };")) == ["GET", "POST", "default", "default@h3.defineEventHandler", "b"]
    config = "export default [index('h'), route('users/:id', 'u', [route('edit', 'e')]), layout('l', [route('about', 'a')]), ...prefix('admin', [index('x'), route('p', 'p')])] satisfies RouteConfig;"
    assert [r["path"] for r in J.config_routes(J.Script(config))] == ["/", "/users/:id", "/users/:id/edit", "/about", "/admin", "/admin/p"]


def test_components():
    text = "<template>\n <p>producer.send({ topic: 'no' })</p>\n</template>\n<script setup lang=\"ts\">\nproducer.send({ topic: 'yes' });\n</script>\n<style>x {}</style>\n"
    view = J.script_view("a/Feed.vue", text)
    assert view.count("\n") == text.count("\n") and "yes" in view and "no" not in view
    out, failed = extract.extract_text("a/Feed.vue", "vue", text)
    assert not failed and [(n["name"], n["line_end"]) for n in out.nodes] == [("Feed", 8)] and [f["target"] for f in out.facts if f["what"] == "producer"] == ["yes"]
    assert "const x" in J.script_view("b.astro", "---\nconst x = 1\n---\n<p>y</p>") and extract.extract_text("r/+page.svelte", "svelte", "<p/>")[0].nodes == []


def test_hostile_texts():
    for text in ("(" * 5000, "a." * 5000 + "send({ topic: 'x' })", "`${" * 500, "producer.send({ topic: " + "'a' + " * 2000 + "'b' });", "import {", "'unclosed", "const a = a + a; producer.send({ topic: a });", "x = /['\"`]/g; producer.send({ topic: 'after' });"):
        J.events(J.Script(text)), J.routes(J.Script(text)), J.procedures(J.Script(text)), J.exports(J.Script(text))
