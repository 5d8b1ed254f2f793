"""Rules of JavaScript and TypeScript broker clients: which call of which library produces or consumes what."""

from __future__ import annotations

from typing import NamedTuple

#: Modules of each library group; one that ends in / stands for all below it (fixed values).
LIBRARIES = {
    "kafkajs": ("kafkajs", "@confluentinc/kafka-javascript"),
    "nest": ("@nestjs/microservices",),
    "kafka_any": ("kafkajs", "@confluentinc/kafka-javascript", "node-rdkafka", "kafka-node", "@platformatic/kafka", "@blizzard/rdkafka"),
    "bull_queues": ("bull", "bee-queue"),
    "kafka_native": ("node-rdkafka", "@confluentinc/kafka-javascript", "@confluentinc/kafka-javascript/", "@blizzard/rdkafka"),
    "redis": ("ioredis", "redis", "@redis/client", "@upstash/redis", "ioredis-mock", "redis-mock", "@nestjs-modules/ioredis", "@liaoliaots/nestjs-redis", "@songkeys/nestjs-redis"),
    "nats": ("nats", "nats.ws", "@nats-io/"),
    "mqtt": ("mqtt", "async-mqtt"),
    "amqp": ("amqplib", "amqp-connection-manager"),
    "sqs": ("@aws-sdk/client-sqs",),
    "sns": ("@aws-sdk/client-sns",),
    "aws_v2": ("aws-sdk",),
    "pubsub": ("@google-cloud/pubsub",),
    "pulsar": ("pulsar-client",),
    "service_bus": ("@azure/service-bus",),
    "kinesis": ("@aws-sdk/client-kinesis",),
    "eventbridge": ("@aws-sdk/client-eventbridge",),
    "stomp": ("@stomp/stompjs", "@stomp/rx-stomp", "stompjs", "stomp-client"),
    "event_hubs": ("@azure/event-hubs",),
    "kafka_node": ("kafka-node",),
    "platformatic": ("@platformatic/kafka",),
    "bullmq": ("bullmq", "@nestjs/bullmq"),
    "bull": ("bull",),
    "bee_queue": ("bee-queue",),
    "nest_bull": ("@nestjs/bull", "@nestjs/bullmq"),
    "nest_rabbit": ("@golevelup/nestjs-rabbitmq",),
    "nest_sqs": ("@ssut/nestjs-sqs",),
}
#: Groups whose clients are told from other objects of a file (fixed values).
TRACKED = ("kafkajs", "kafka_native", "kafka_node", "platformatic", "redis", "nats", "mqtt", "amqp", "aws_v2", "pubsub", "pulsar", "service_bus", "stomp", "nest")


class Rule(NamedTuple):
    group: str | None
    names: tuple[str, ...]
    role: str
    kind: str
    extract: str
    when: str | None = None


#: Method calls (fixed values).
CALLS = (
    Rule(None, ("send",), "produce", "kafka_topic", "kafka_send_topic", "kafka_receiver"),
    Rule(None, ("subscribe",), "consume", "kafka_topic", "kafka_subscribe_topics", "kafka_receiver"),
    Rule(None, ("sendBatch",), "produce", "kafka_topic", "kafka_send_batch", "kafka_receiver"),
    Rule("kafka_native", ("produce",), "produce", "kafka_topic", "first_arg"),
    Rule("kafka_native", ("subscribe",), "consume", "kafka_topic", "first_arg"),
    Rule("kafka_node", ("send",), "produce", "kafka_topic", "kafka_node_send"),
    Rule("platformatic", ("send",), "produce", "kafka_topic", "platformatic_send"),
    Rule("platformatic", ("consume",), "consume", "kafka_topic", "kafka_subscribe_topics"),
    Rule("bull_queues", ("process",), "consume", "queue", "queue_of_receiver"),
    Rule(None, ("emit", "send"), "produce", "kafka_topic", "first_arg", "nest_client"),
    Rule("redis", ("publish", "xadd", "xAdd"), "produce", "event_stream", "first_arg"),
    Rule("redis", ("subscribe", "psubscribe", "pSubscribe"), "consume", "event_stream", "all_string_args"),
    Rule("redis", ("xread", "xRead", "xreadgroup", "xReadGroup"), "consume", "event_stream", "redis_stream_read"),
    Rule("nats", ("publish", "request"), "produce", "event_stream", "first_arg"),
    Rule("nats", ("subscribe",), "consume", "event_stream", "first_arg"),
    Rule("mqtt", ("publish",), "produce", "event_stream", "first_arg"),
    Rule("mqtt", ("subscribe", "subscribeAsync"), "consume", "event_stream", "mqtt_subscribe"),
    Rule("amqp", ("sendToQueue",), "produce", "queue", "first_arg"),
    Rule("amqp", ("consume",), "consume", "queue", "first_arg"),
    Rule("amqp", ("publish",), "produce", "event_stream", "amqp_exchange"),
    Rule("aws_v2", ("sendMessage", "sendMessageBatch"), "produce", "queue", "sqs_queue"),
    Rule("aws_v2", ("receiveMessage",), "consume", "queue", "sqs_queue"),
    Rule("aws_v2", ("publish",), "produce", "event_stream", "sns_topic"),
    Rule("pubsub", ("publishMessage", "publishJSON", "publish"), "produce", "event_stream", "pubsub_topic_chain"),
    Rule("pubsub", ("subscription",), "consume", "event_stream", "pubsub_topic_chain"),
    Rule("pulsar", ("createProducer",), "produce", "event_stream", "pulsar_topic"),
    Rule("pulsar", ("subscribe", "createReader"), "consume", "event_stream", "pulsar_topic"),
    Rule("service_bus", ("createSender",), "produce", "queue", "first_arg"),
    Rule("service_bus", ("createReceiver",), "consume", "queue", "first_arg"),
    Rule("redis", ("lpush", "lPush", "rpush", "rPush"), "produce", "queue", "first_arg"),
    Rule("redis", ("brpop", "bRPop", "blpop", "bLPop"), "consume", "queue", "key_args"),
    Rule("redis", ("rpop", "rPop", "lpop", "lPop", "lmove", "lMove", "blmove", "bLMove", "rpoplpush", "rPopLPush", "brpoplpush", "bRPopLPush"), "consume", "queue", "first_arg"),
    Rule("redis", ("lmove", "lMove", "blmove", "bLMove", "rpoplpush", "rPopLPush", "brpoplpush", "bRPopLPush"), "produce", "queue", "second_arg"),
    Rule("stomp", ("publish",), "produce", "event_stream", "stomp_destination"),
    Rule("stomp", ("subscribe",), "consume", "event_stream", "first_arg"),
)
#: Constructors; ``default`` is a module's default export, names of bullmq count without an import too (fixed values).
CONSTRUCTORS = (
    Rule("bullmq", ("Queue",), "produce", "queue", "queue_name_arg", "unbound"),
    Rule("bullmq", ("Worker",), "consume", "queue", "queue_name_arg", "unbound"),
    Rule("bull", ("default",), "produce", "queue", "first_arg"),
    Rule("bee_queue", ("default",), "produce", "queue", "first_arg"),
    Rule("kafka_node", ("Consumer",), "consume", "kafka_topic", "kafka_node_consumer"),
    Rule("kafka_node", ("ConsumerGroup",), "consume", "kafka_topic", "second_arg"),
    Rule("event_hubs", ("EventHubProducerClient",), "produce", "event_stream", "event_hub_name"),
    Rule("event_hubs", ("EventHubConsumerClient",), "consume", "event_stream", "event_hub_name"),
    Rule("sqs", ("SendMessageCommand", "SendMessageBatchCommand"), "produce", "queue", "sqs_queue"),
    Rule("sqs", ("ReceiveMessageCommand",), "consume", "queue", "sqs_queue"),
    Rule("sns", ("PublishCommand", "PublishBatchCommand"), "produce", "event_stream", "sns_topic"),
    Rule("kinesis", ("PutRecordCommand", "PutRecordsCommand"), "produce", "event_stream", "kinesis_stream"),
    Rule("kinesis", ("GetShardIteratorCommand",), "consume", "event_stream", "kinesis_stream"),
    Rule("eventbridge", ("PutEventsCommand",), "produce", "event_stream", "eventbridge_events"),
)
#: Decorators (fixed values).
DECORATORS = (
    Rule("nest_bull", ("Processor",), "consume", "queue", "processor_queue"),
    Rule("nest_bull", ("InjectQueue",), "produce", "queue", "first_arg"),
    Rule("nest_rabbit", ("RabbitSubscribe", "RabbitRPC"), "consume", "queue", "rabbit_queue"),
    Rule("nest_sqs", ("SqsMessageHandler",), "consume", "queue", "first_arg"),
)
#: Handlers of NestJS messages (fixed values).
PATTERNS = ("EventPattern", "MessagePattern")

#: HTTP frameworks, clients that only make requests, and decorators of routes (fixed values).
FRAMEWORKS = {
    "express": ("express",), "fastify": ("fastify",), "koa": ("@koa/router", "koa-router"), "hono": ("hono",), "elysia": ("elysia",), "h3": ("h3",),
    "restify": ("restify",), "polka": ("polka",), "itty": ("itty-router",), "hapi": ("@hapi/hapi", "hapi"),
}
HTTP_CLIENTS = ("axios", "got", "ky", "superagent", "supertest", "node-fetch", "undici", "ofetch", "needle", "request", "@angular/common/http")
ROUTE_VERBS = ("get", "post", "put", "patch", "delete", "del", "head", "options", "all", "any")
VERB_DECORATORS = {
    "Get": "GET", "Post": "POST", "Put": "PUT", "Patch": "PATCH", "Delete": "DELETE", "Head": "HEAD", "Options": "OPTIONS", "All": "ALL",
    "httpGet": "GET", "httpPost": "POST", "httpPut": "PUT", "httpPatch": "PATCH", "httpDelete": "DELETE", "httpHead": "HEAD", "httpOptions": "OPTIONS", "httpAll": "ALL",
}
DECORATOR_LIBRARIES = (
    "@nestjs/common", "routing-controllers", "tsoa", "inversify-express-utils", "@tsed/schema", "@tsed/common", "@overnightjs/core", "@decorators/express",
    "@midwayjs/core", "@midwayjs/decorator",
)
CONTROLLER_DECORATORS = ("Controller", "JsonController", "Route", "controller")
TRPC_LIBRARIES = ("@trpc/server",)
GRAPHQL_LIBRARIES = (
    "graphql", "graphql-tag", "@apollo/server", "@apollo/subgraph", "apollo-server", "apollo-server-express", "apollo-server-core", "graphql-yoga",
    "@graphql-yoga/", "@graphql-tools/", "mercurius", "@pothos/", "@nestjs/graphql", "@nestjs/apollo",
)
GRAPHQL_DECORATOR_LIBRARIES = ("@nestjs/graphql", "type-graphql")
OPERATIONS = ("Query", "Mutation", "Subscription")


def below(module: str, libraries: tuple[str, ...]) -> bool:
    """Whether a module is one of some libraries or lies below it."""
    return any(module == lib.rstrip("/") or module.startswith(lib.rstrip("/") + "/") for lib in libraries)
